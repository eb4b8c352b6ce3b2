"""Personal data: fixed formats, and information-theoretic sanitisation.  DataFrame functions only.

Formats (email, ip, card, phone) are leftmost non-overlapping matches, checked afterwards.  What
a match names is a protected entity.  Its information content is -log2 of the share of texts
that hold it; a term (a run of letters and digits outside the accepted matches) discloses it by
its pointwise mutual information with it,

    PMI(term, entity) = log2(N n(term, entity) / (n(term) n(entity))),

estimated from the co-occurrence in all texts.  A term whose PMI reaches ``GENERALISE`` of the
entity's information content is generalised where it stands in a text with that entity, one
that reaches ``REMOVE`` of it is removed.  Most entities are rare, so each one is judged by
itself and as one of its pool (an email's domain, an ip's network, a card's issuer, a phone
number's country and area): a term that discloses the pool is treated where the pool's members
stand.  There is no least count.  Instead the co-occurrence must be more than chance: by the
Chernoff bound, at most ``FALSE_TERMS`` of all different terms may be expected to stand as often
with an entity (or pool) if they were dealt at random.  Copies are no further evidence.

- The formats are matched once for each row, as long as the hashes of the texts that hold personal
  data can be broadcast to tell them from the others.
- Offsets are running sums of the lengths of the matches and of the gaps between them.  Sums, masks
  and clean texts take n log n steps for n spans of a text (``scan``).
- Only texts with personal data are paired with terms.  Entities, pools, terms and pairs that could
  not pass the bound, or not reach the share, even if they always stood together are not paired,
  which changes no result.  Counts of terms cover all texts and all terms, also the short ones.
- N, n(term), n(entity) and n(term, entity) are counts of different texts (by 128 bits of SHA-256), so
  copies change nothing.

Offsets are code points, ends exclusive.  Null text counts as empty: no spans.  Long texts are
whole.  Matches of one kind do not overlap (leftmost first); those of several kinds may, and all are
given.  A share that just reaches a threshold counts as reaching it.  Repeated rows are treated
alike; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.joins import BROADCAST_MAX_ROWS, bounded_broadcast
from .common import read, store

KINDS = ("email", "ip", "card", "phone")
# fixed values: the formats, written so that long runs are passed over once (possessive, and only
# from a run's begin or the last match's end; what matches is the same)
_MAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]+"
#: Terms that may be expected to pass with one entity or pool by chance.
FALSE_TERMS = 0.05
GENERALISE, REMOVE = 0.8, 0.95
_SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once: inside nested functions it would be again and again."""
    return F.transform(F.array(value), of)[0]


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` (0 is neutral) over an array of ints.

    In step k every value takes in the one 2^k places before it, so log n steps are enough.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        back = F.least(F.pow(F.lit(2.0), k).cast("int"), F.size(acc))
        return F.zip_with(acc, F.slice(F.concat(F.array_repeat(F.lit(0), back), acc), F.lit(1), F.size(acc)), op)

    return F.aggregate(steps, values.cast("array<int>"), step)


def spans_of(found: Column, gaps: Column) -> Column:
    """Array of start, end, value: the matches, with the lengths of the gaps before them."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: (g + F.length(v)).cast("int"))
    ends = scan(lengths, lambda x, y: x + y)
    return F.zip_with(found, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))


def matches(text: Column, pattern: str) -> Column:
    """All matches: array of start, end, value."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    placed = let(found, lambda f: F.when(F.size(f) > 0, let(gaps, lambda g: spans_of(f, g))).otherwise(F.array().cast(_SPAN)))
    return placed.cast(_SPAN)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: _luhn_digit(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(places, F.lit(0), lambda a, d: a + d) % 10 == 0


def _luhn_digit(d: Column, doubled: Column) -> Column:
    twice = d * 2
    return F.when(doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)


def _check(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _spans(kind: str) -> Column:
    # a cheap look first: most texts have none of the signs that a kind needs
    sign = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}.get(kind, F.col("text").rlike("[0-9]"))
    found = F.filter(matches(F.col("text"), PATTERNS[kind]), lambda s: _check(kind, s["value"]))
    return F.when(sign, found).otherwise(F.array().cast(_SPAN))


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else F.regexp_replace(value, "[^0-9.]" if kind == "ip" else "[^0-9]", ""))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _pool(kind: str, value: Column) -> Column:
    """What an entity shares with its like: domain, network (two bytes), issuer (six digits), all but seven digits."""
    if kind == "email":
        return F.concat(F.lit("domain:"), F.lower(F.substring_index(value, "@", -1)))
    if kind == "ip":
        return F.concat(F.lit("network:"), F.regexp_replace(F.substring_index(value, ".", 2), r"(?<![0-9])0+(?=[0-9])", ""))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))
    return F.concat(F.lit("area:"), F.substring(digits, F.lit(1), F.length(digits) - 7))


def _divergence(k: Column, n: Column, p: Column) -> Column:
    """-log of the Chernoff bound for at least ``k`` hits of ``n`` at probability ``p`` (0 if no more than expected)."""
    rate = k / n
    misses = F.when(k < n, (n - k) * F.log((1 - rate) / (1 - p))).otherwise(F.lit(0.0))
    return F.when(rate > p, k * F.log(rate / p) + misses).otherwise(F.lit(0.0))


def disclosing(texts: DataFrame, different: DataFrame, total: int) -> DataFrame:
    """(entity, term, level): level 2 to remove, 1 to generalise; an entity or a pool.

    ``different``: the terms (different ones) of each of the ``total`` different texts.
    ``texts``: those with personal data: hash, terms and entities (pools among them).
    """
    counts = different.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counts = store(counts, "terms")
    rows = counts.count()
    least = log(max(rows, 1) / FALSE_TERMS)
    n = F.lit(float(max(total, 1)))

    def can_pass(count: str) -> Column:  # the most that the bound gives: always together, never apart
        return F.col(count) * F.log(n / F.col(count)) >= least

    entities = texts.select("hash", F.explode("entities").alias("entity"))
    judged = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(can_pass("n_entity"))
    entities = entities.join(judged, "entity")
    ranges = entities.groupBy("hash").agg(F.min("n_entity").alias("low"), F.max("n_entity").alias("high"))
    terms = texts.join(ranges, "hash").select("hash", "low", "high", F.explode("terms").alias("term"))
    partners = counts.filter(can_pass("n_term"))
    partners = bounded_broadcast(partners, *partners.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first())
    terms = terms.join(partners, "term")

    def chance(both: Column, of: Column) -> Column:
        return F.greatest(_divergence(both, of, F.col("n_term") / n), _divergence(both, F.col("n_term"), of / n))

    def share(both: Column, of: Column) -> Column:
        return F.log2(n * both / (F.col("n_term") * of)) / F.log2(n / of)

    def hopeful(of: Column) -> Column:
        # together as often as at all: bound and share only rise with the count of both (less a little for rounding)
        most = F.least(of, F.col("n_term"))
        return (chance(most, of) >= least * 0.999999) & (share(most, of) >= GENERALISE - 1e-9)

    # always together, bound and share are highest for the entity whose count is nearest to the term's
    terms = terms.filter(hopeful(F.least(F.greatest("n_term", "low"), F.col("high")))).drop("low", "high")
    pairs = entities.join(terms, "hash").filter(hopeful(F.col("n_entity"))).groupBy("entity", "term")
    pairs = pairs.agg(F.count(F.lit(1)).alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    both, of = F.col("n_both"), F.col("n_entity")
    level = F.when(share(both, of) >= REMOVE, 2).when(share(both, of) >= GENERALISE, 1)
    return pairs.filter(chance(both, of) >= least).select("entity", "term", level.alias("level")).filter("level IS NOT NULL")


def rebuilt(text: Column, spans: Column, fill: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with its spans (sorted by start) replaced.

    ``fill`` gives what stands for a span from: the text before it that no earlier span covers,
    the end of what is covered so far, and the span.
    """

    def pieces(chars: Column) -> Column:
        def whole(ends: Column) -> Column:
            at = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
            before = lambda a, s: F.array_join(F.slice(chars, a + 1, F.greatest(s["start"] - a, F.lit(0))), "")
            parts = F.zip_with(at, spans, lambda a, s: fill(before(a, s), a, s))
            last = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0))
            return F.concat(F.array_join(parts, ""), F.array_join(F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0))), ""))

        return let(scan(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), whole)

    return let(F.split(text, ""), pieces)


def _masked() -> Column:
    """The text with its accepted spans blanked, at the same length."""
    spans = F.sort_array(F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS]))
    blank = lambda n: F.repeat(F.lit(" "), F.greatest(n, F.lit(0)))
    return let(spans, lambda x: rebuilt(F.col("text"), x, lambda before, at, s: F.concat(before, blank(s["end"] - F.greatest(at, s["start"])))))


def _different(rows: DataFrame, base: DataFrame) -> tuple[DataFrame, int]:
    """Every different text of ``rows`` (hash, text) once, and their number.  Only copied texts are shuffled."""
    copies = store(base.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    groups, members = copies.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    copied = bounded_broadcast(copies.select("hash"), groups, 64 * groups)
    single = rows.join(copied, "hash", "left_anti")
    return single.unionByName(rows.join(copied, "hash", "left_semi").dropDuplicates(["hash"])), base.count() - members + groups


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, one array of spans for each kind, and terms: array of start, end, level.

    One row for each row of ``docs`` (doc_id, text).
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(32)))
    some = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    found = rows.select("doc_id", digest.alias("hash"), "text", *[_spans(k).alias(k) for k in KINDS])
    # the texts are kept only where they hold personal data
    base = store(found.withColumn("text", F.when(some, F.col("text"))), "pii")
    entities = F.array_distinct(F.concat(*[_entities(k, of) for k in KINDS for of in (_entity, _pool)]))
    texts = base.filter(some).drop("doc_id").dropDuplicates(["hash"])
    texts = texts.select("hash", "text", *KINDS, F.array_distinct(_terms(_masked())).alias("terms"), entities.alias("entities"))
    texts = store(texts, "pii-texts")
    # all other texts are terms as they stand; which they are is known by their hashes, or else by the formats once more
    n = texts.count()
    if n <= BROADCAST_MAX_ROWS:
        plain = rows.select(digest.alias("hash"), "text").join(bounded_broadcast(texts.select("hash"), n, 16 * n), "hash", "left_anti")
    else:
        plain = found.filter(~some).select("hash", "text")
    plain, total = _different(plain, base)
    different = texts.select("terms").unionByName(plain.select(F.array_distinct(_terms(F.col("text"))).alias("terms")))
    flagged = store(disclosing(texts, different, total), "flagged")
    flagged = bounded_broadcast(flagged, *flagged.agg(F.count(F.lit(1)), F.sum(F.octet_length("entity") + F.octet_length("term"))).first())
    of_text = (
        texts.select("hash", F.explode("entities").alias("entity"))
        .join(flagged, "entity")
        .groupBy("hash", "term")
        .agg(F.max("level").alias("level"))
    )
    # rows without personal data join nothing: a key of their own keeps them from one task
    own = F.unhex(F.md5(F.concat(F.lit("row "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    keyed = base.select("doc_id", *KINDS, F.when(some, F.col("hash")).otherwise(own).alias("hash"))
    return keyed.join(_term_spans(texts, store(of_text, "flagged-of-text")), "hash", "left").select(
        "doc_id", *KINDS, F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,level:int>>")).alias("terms")
    )


def _entities(kind: str, of: Callable) -> Column:
    return F.transform(F.col(kind), lambda s: of(kind, s["value"]))


def _term_spans(texts: DataFrame, of_text: DataFrame) -> DataFrame:
    """hash, terms: where the flagged terms stand in the masked text (its offsets are the text's)."""
    n, held_bytes, held = of_text.agg(F.count(F.lit(1)), F.sum(16 + F.octet_length("term")), F.count_distinct("hash")).first()
    small = bounded_broadcast(of_text, n, held_bytes or 0)
    keys = bounded_broadcast(of_text.select("hash").distinct(), held, 16 * held)
    words = texts.join(keys, "hash", "left_semi").select("hash", _masked().alias("text")).select("hash", matches(F.col("text"), TERM).alias("words"))
    placed = words.select("hash", F.inline("words")).select("hash", "start", "end", F.lower("value").alias("term"))
    hit = placed.join(small, ["hash", "term"])
    return hit.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "level"))).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and clean: the text with personal data replaced by its kind, terms by [term] or nothing."""
    # joined by the text itself: spans depend on nothing else
    found = find_pii(docs.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id", "text"]))
    kinds = [_replaced(k) for k in KINDS]
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["level"] > 1, "").otherwise("[term]").alias("as")))
    spans = found.select(F.col("doc_id").alias("_key"), F.sort_array(F.concat(*kinds, terms)).alias("_spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("_key")).join(spans, "_key", "left")
    # a span that overlaps an earlier one adds only what lies beyond it
    clean = rebuilt(F.col("text"), F.col("_spans"), lambda before, at, s: F.when(s["start"] >= at, F.concat(before, s["as"])).otherwise(F.lit("")))
    return joined.select("doc_id", F.when(F.size("_spans") > 0, clean).otherwise(F.col("text")).alias("clean"))


def _replaced(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("as")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.filter(spans, lambda s: s != ""), ",")


def _listed(kind: str, column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that disclose it."""
    found = find_pii(read(spark, sf_dir, "documents", "doc_id", "text"))
    lists = [_listed(k, k) for k in KINDS]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.array(*lists)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array(*lists, _listed("term", "terms"))).alias("spans"),
    )
