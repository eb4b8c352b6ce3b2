"""Line deduplication: lines that many documents hold leave every document.

1. Each text is cut at ``\\n``; a line's key is the line without ASCII white space at both ends, A-Z
   lower-cased.  Keys are hashed to 128 bits (MD5), the different hashes of a row are exploded, and a
   map-side combined count gives the documents of each.  A line that a third of all documents
   hold is one row of each task before the shuffle.
2. The lines are exploded with their positions and joined with the hashes over the threshold.  If
   these are too many for a broadcast, the most frequent ones still are: at most ``MAX_HOT`` hashes
   can stand in more than total / MAX_HOT documents.  The rest have no hot key and are shuffled.
3. The positions to drop are gathered by the text's SHA-256 (copies share them, combined map-side),
   and each text is put together again from the positions that stay, in their order.

Every row is a document: repeated rows count one by one, also rows with the same or no doc_id.  Null
and empty texts have one empty line.  Keys shorter than ``min_chars`` code points always stay;
``min_chars`` of 0 makes the empty key droppable too.  A text whose lines all go becomes empty.  A
threshold that is just reached drops (ties are dropped).  An empty table gives an empty result.
Long texts are treated whole, in time linear in their lines.  Other columns are never read
(``line_dedup``) or passed on untouched, whatever their names (``deduped_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.joins import bounded_broadcast
from .common import read, store

LEAST_DOCS = 10
MIN_CHARS = 1
#: At most so many of the most frequent lines are broadcast when all of them are too many.
MAX_HOT = 200_000
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def line_hash(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """128 bits of a line's key as digits; null where the key is too short to be judged."""
    bare = F.btrim(line, F.lit(_BLANK))
    ascii_only = F.octet_length(bare) == F.length(bare)  # then lower() is just A-Z, and fast
    key = F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))
    digest = F.md5(key.cast("binary"))
    return F.when(F.length(bare) >= min_chars, digest) if min_chars > 0 else digest


def frequent_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, docs): the lines that stand in at least ``least_docs`` rows of ``rows`` (text)."""
    # distinct strings are looked up by hash, distinct binaries would be compared one by one
    of_row = F.array_distinct(F.transform(_lines("text"), lambda x: line_hash(x, min_chars)))
    held = rows.select(F.explode(of_row).alias("digits")).filter("digits IS NOT NULL").select(F.unhex("digits").alias("hash"))
    return held.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least_docs)


def _hits(lines: DataFrame, frequent: DataFrame, max_rows: int) -> DataFrame:
    """The rows of ``lines`` whose hash is frequent."""
    n, total = frequent.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    if n <= max_rows:
        return lines.join(bounded_broadcast(frequent.select("hash"), n, 16 * n), "hash", "left_semi")
    least = total / max(1, min(MAX_HOT, max_rows))  # fewer hashes than that can have more documents
    hot = F.broadcast(frequent.filter(F.col("docs") > least).select("hash"))
    rest = frequent.filter(F.col("docs") <= least).select("hash")
    return lines.join(hot, "hash", "left_semi").unionByName(lines.join(hot, "hash", "left_anti").join(rest, "hash", "left_semi"))


def _judged(rows: DataFrame, least_docs: int, min_chars: int, max_broadcast: int) -> DataFrame:
    """``rows`` (row, text) with n_lines, n_dropped and kept."""
    frequent = store(frequent_lines(rows, least_docs, min_chars), "frequent-lines")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    lines = rows.select(digest.alias("digest"), "text")  # before the lines are exploded: once for each text
    lines = lines.select("digest", F.posexplode(_lines("text")).alias("at", "line"))
    lines = lines.select("digest", "at", F.unhex(line_hash(F.col("line"), min_chars)).alias("hash"))
    hits = _hits(lines, frequent, max_broadcast)
    drops = store(hits.groupBy("digest").agg(F.collect_set("at").alias("gone")), "dropped-lines")
    n, gone = drops.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    small = bounded_broadcast(drops, n, 32 * n + 4 * gone) if n <= max_broadcast else drops
    keyed = rows.select("row", "text", digest.alias("digest")).join(small, "digest", "left")
    keyed = keyed.select("row", "text", _lines("text").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # array_except keeps the order and looks its second side up by hash; ``lines`` is used twice,
    # so it stays a column of its own and is not cut again for each position
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda at: F.element_at("lines", at + 1)), "\n")
    return keyed.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") > 0, kept).otherwise(F.col("text")).alias("kept"),
    )


def line_dedup(
    docs: DataFrame, least_docs: int = LEAST_DOCS, min_chars: int = MIN_CHARS, max_broadcast: int = 1_000_000
) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text that stays) for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    judged = _judged(docs.select(F.struct("doc_id").alias("row"), text), least_docs, min_chars, max_broadcast)
    return judged.select("row.doc_id", "n_lines", "n_dropped", "kept")


def deduped_rows(
    docs: DataFrame, least_docs: int = LEAST_DOCS, min_chars: int = MIN_CHARS, max_broadcast: int = 1_000_000
) -> DataFrame:
    """The rows of ``docs`` with the same columns; the text is what stays of it (null becomes empty)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(True).alias("_"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    judged = _judged(docs.select(row.alias("row"), text), least_docs, min_chars, max_broadcast)
    return judged.select(*[F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 10 documents leave all documents."""
    out = line_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS MATERIALIZED (
  SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), keyed AS MATERIALIZED (
  SELECT r, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS MATERIALIZED (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n
  FROM keyed WHERE key NOT IN (SELECT key FROM frequent) GROUP BY r
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
