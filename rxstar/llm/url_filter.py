"""URL filters: Bloom filter cascades.

Rules are keys of a host and a path.  The corpus's key universe is every host suffix with every
path prefix that could be a rule (only the label counts and path lengths that rules have).  The
first filter of a cascade encodes the listed keys; the second one the keys of the universe that
pass it without being listed; the third the listed keys that pass the second; and so on until
none are left.  Passing or failing the filters in turn then tells exactly, for every key of the
universe, whether it is listed, without a join: one cascade tells rules from other keys, one
tells block rules from allow rules.

Each filter is built by Spark tasks (partial bit sets, combined by position) and is broadcast;
its size follows the keys it holds, and rules are cut into slices of at most ``SLICE`` keys, each
with cascades of its own, so no broadcast exceeds a fixed bound whatever the number of rules.

A url that is null or without "://" has an empty host and path.  Rules with a null or empty host
are ignored; a null path is empty; a key that is both allowed and blocked is blocked.  Of rules
that fit, the longest wins (host and path together; of equal lengths the longer host).  A url
without a rule is not listed, so it is allowed.  Repeated rows and extra columns change nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, ship, store

#: Keys of a slice; a filter takes some 30 bits for each, so 16 MB at most.
SLICE = 1 << 22
MAX_LEVELS = 64
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
# fixed values: the rules of the query
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def candidates(host: str, path: str, shapes: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(host length, host and path) of every rule that could fit, longest first.

    ``shapes``: (labels of the host, length of the path) that rules have.
    """
    if not host:
        return []
    labels = host.split(".")
    tails = {n: ".".join(labels[-n:]) for n in {n for n, _ in shapes} if n <= len(labels)}
    keys = [(len(tails[n]), tails[n] + path[:size]) for n, size in shapes if n in tails and size <= len(path)]
    return sorted(set(keys), key=lambda k: (-len(k[1]), -k[0]))


def key_text(host_length: int, key: str) -> str:
    """A key with the place where its path begins, so that no two keys read alike."""
    return f"{host_length}:{key}"


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter: ``bits`` packed little-endian, ``hashes`` probes of a key."""

    bits: np.ndarray
    size: int
    hashes: int
    seed: int

    def has(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in places(key, self.size, self.hashes, self.seed))


def places(key: str, size: int, hashes: int, seed: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace"), seed)
    a, b = h >> 64, h & ((1 << 64) - 1) | 1
    return [(a + i * b) % size for i in range(hashes)]


def _set_bits(size: int, hashes: int, seed: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, int] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in places(key, size, hashes, seed):
                    words[p >> 5] = words.get(p >> 5, 0) | 1 << (p & 31)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "bits"])

    return run


def build_filter(keys: DataFrame, count: int, rate: float, seed: int) -> Bloom:
    """A filter of ``count`` keys (column key) that others pass at ``rate``.

    The driver gathers the words of the bit set: a size that follows ``count``, at most SLICE.
    """
    size = max(64, ceil(-count * log(rate) / log(2) ** 2))
    hashes = max(1, round(-log2(rate)))
    words = keys.mapInArrow(_set_bits(size, hashes, seed), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = np.zeros(-(-size // 32), "<u4")
    for row in words.toLocalIterator():
        bits[row[0]] = row[1]
    return Bloom(bits.view(np.uint8), size, hashes, seed)


def listed(levels: list[Bloom], key: str) -> bool:
    """Exact membership for a key of the universe (or a listed one)."""
    for n, level in enumerate(levels):
        if not level.has(key):
            return n % 2 == 1
    return len(levels) % 2 == 1


def _passing(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            yield batch.filter(pa.array([level.has(k) for k in batch.column(0).to_pylist()], pa.bool_()))

    return run


def build_cascade(keys: DataFrame, universe: DataFrame, seed: int = 0) -> list[Bloom]:
    """Filters that tell the listed ``keys`` from the rest of ``universe`` (columns key, distinct)."""
    context = keys.sparkSession.sparkContext
    holds, others = keys, universe.join(keys, "key", "left_anti")
    n_holds, n_others = holds.count(), others.count()
    levels: list[Bloom] = []
    while n_holds:
        rate = 0.5 if levels else min(0.5, max(sqrt(0.5) * n_holds / max(n_others, 1), 1e-6))
        level = build_filter(holds, n_holds, rate, seed + len(levels))
        levels.append(level)
        if len(levels) > MAX_LEVELS:
            raise RuntimeError("two keys cannot be told apart by their hashes")
        wrong = store(others.mapInArrow(_passing(context.broadcast(level)), "key string"), "passing")
        holds, others = wrong, holds
        n_holds, n_others = wrong.count(), n_holds
    return levels


def _keys_of(shapes: list[tuple[int, int]]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {key_text(*k) for u in batch.column(0).to_pylist() for k in candidates(*split_url(u), shapes)}
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string())], names=["key"])

    return run


_JUDGED = "_row_host string, _row_path string, _rule string, _host_length int, _block boolean"


def _judge(shared, shapes: list[tuple[int, int]], schema: pa.Schema | None = None) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, blocks = shared.value
        for batch in batches:
            names = batch.schema.names
            out = []
            old = zip(*(batch.column(names.index(c)).to_pylist() for c in ("rule", "host_length", "blocked")))
            for url, best in zip(batch.column(names.index("url")).to_pylist(), old):
                host, path = split_url(url)
                for n, key in candidates(host, path, shapes):
                    if best[0] is not None and (len(best[0]), best[1]) >= (len(key), n):
                        break
                    if listed(rules, key_text(n, key)):
                        best = (key, n, listed(blocks, key_text(n, key)))
                        break
                out.append((host, path, *best))
            got = list(zip(*out)) or [(), (), (), (), ()]
            new = dict(zip(("host", "path", "rule", "host_length", "blocked"), got))
            kinds = {"host_length": pa.int32(), "blocked": pa.bool_()}
            columns = [pa.array(new[c], kinds.get(c, pa.string())) if c in new else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, slice_keys: int = SLICE) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url).

    ``rules``: verdict (allow or block), host, path.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    path = F.coalesce("path", F.lit(""))
    keyed = rules.filter("host <> '' AND verdict IN ('allow', 'block')").select(
        F.size(F.split(host, r"\.")).alias("labels"),
        F.length(path).alias("size"),
        F.concat(F.length(host).cast("string"), F.lit(":"), host, path).alias("key"),
        (F.col("verdict") == "block").alias("block"),
    )
    keyed = store(keyed.groupBy("labels", "size", "key").agg(F.max("block").alias("block")), "rules")
    # label counts and path lengths: bounded by the longest host and path, not by the rules
    shapes = [(r[0], r[1]) for r in keyed.select("labels", "size").distinct().collect()]
    n_slices = max(1, ceil(keyed.count() / (slice_keys * 3 / 4)))
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(n_slices)))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    universe = store(rows.select("url").mapInArrow(_keys_of(shapes), "key string").distinct(), "universe")
    kinds = "host string, path string, rule string, host_length int, blocked boolean"
    rows = rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in kinds.split(", "))])
    for n in range(n_slices):
        own = keyed.filter(F.col("slice") == n)
        keys, blocks = own.select("key"), own.filter("block").select("key")
        cascades = build_cascade(keys, universe, 1000 * n), build_cascade(blocks, keys, 1000 * n + 500)
        rows = rows.mapInArrow(_judge(spark.sparkContext.broadcast(cascades), shapes), rows.schema)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the fixed rules on every url of pages."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), rules)


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
  FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""
