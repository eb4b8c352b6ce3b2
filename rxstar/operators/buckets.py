"""Copy-on-write merge: a stored table in buckets of its key, of which a merge rewrites only the touched ones.

A row's bucket is a hash of its key.  A merge finds the buckets that its changes fall in, merges
these alone with what they hold, and writes them as a new version beside the old ones.  The manifest
names the version of each bucket; it is appended to once the data is whole, so readers see
a merge wholly or not at all, and a failed one leaves the table as it was.  One writer at a time.
Old versions stay until somebody removes them.

Only the list of buckets (a fixed number) reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.materialize import materialize
from .sinks import commit_version, latest_version
from .upsert import merge_rows, same

BUCKETS = 64
_BUCKET = "_bucket"
_MANIFEST = "bucket int, rows long, version long"


@dataclass(frozen=True)
class BucketTable:
    """A table in buckets: where it is, its key, and how keys are compared."""

    base: str
    key: tuple[str, ...]
    schema: T.StructType
    buckets: int

    def bucket_of(self, match: Callable[[Column], Column] = same) -> Column:
        hashed = F.xxhash64(*[match(F.col(k)) if isinstance(self.schema[k].dataType, T.StringType) else F.col(k) for k in self.key])
        return F.pmod(hashed, F.lit(self.buckets)).cast("int")


def _describe(table: BucketTable) -> str:
    return json.dumps({"key": list(table.key), "buckets": table.buckets, "schema": table.schema.json()})


def open_table(spark: SparkSession, base: str) -> BucketTable:
    """The table stored under ``base``."""
    about = json.loads(spark.read.text(f"{base}/_table").first()[0])
    return BucketTable(base, tuple(about["key"]), T.StructType.fromJson(json.loads(about["schema"])), about["buckets"])


def current_buckets(spark: SparkSession, base: str) -> dict[int, tuple[int, int]]:
    """bucket -> (its newest committed version, its rows); at most a row for each bucket is collected."""
    newest = latest_version(spark, base)
    if not newest:
        return {}
    log = spark.read.schema(_MANIFEST).parquet(f"{base}/_buckets").where(F.col("version") <= newest)
    last = log.groupBy("bucket").agg(F.max(F.struct("version", "rows")).alias("last"))
    return {r["bucket"]: (r["last"]["version"], r["last"]["rows"]) for r in last.collect()}


def read_table(spark: SparkSession, base: str, only: set[int] | None = None) -> DataFrame:
    """All rows as of the last committed merge (of the buckets in ``only``, where given)."""
    table = open_table(spark, base)
    paths = [f"{base}/data/version={v}/{_BUCKET}={b}" for b, (v, _) in sorted(current_buckets(spark, base).items()) if only is None or b in only]
    if not paths:
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).parquet(*paths)


def _write(spark: SparkSession, table: BucketTable, rows: DataFrame, match: Callable[[Column], Column]) -> dict[int, int]:
    """Write ``rows`` as the next version of their buckets, and commit it; returns the rows of each."""
    version = latest_version(spark, table.base) + 1
    path = f"{table.base}/data/version={version}"
    dealt = rows.select(*table.schema.names, table.bucket_of(match).alias(_BUCKET)).repartition(_BUCKET)
    dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(path)
    stored = spark.read.schema(T.StructType([*table.schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(path)
    counts = {r[_BUCKET]: r["n"] for r in stored.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}  # from footers
    # a folder for each version: what a merge that failed before its commit has left is written over
    entries = spark.createDataFrame(sorted(counts.items()), "bucket int, rows long")
    entries.coalesce(1).write.mode("overwrite").parquet(f"{table.base}/_buckets/version={version}")
    commit_version(spark, table.base, version)
    return counts


def create_table(rows: DataFrame, base: str, key: list[str], buckets: int = BUCKETS, match: Callable[[Column], Column] = same) -> BucketTable:
    """Store ``rows`` (unique by ``key``) as a new table under ``base``."""
    spark = rows.sparkSession
    table = BucketTable(base, tuple(key), T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]), buckets)
    spark.createDataFrame([(_describe(table),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_table")
    _write(spark, table, rows, match)
    return table


def merge_table(
    spark: SparkSession,
    base: str,
    changes: DataFrame,
    keep: list[str] | None = None,
    number: str | None = None,
    groups: list[str] | None = None,
    match: Callable[[Column], Column] = same,
) -> dict[int, int]:
    """Merge ``changes`` (unique by key) into the table; returns the rows of each bucket that was rewritten.

    Matched rows take the columns of the change but for those in ``keep``; with ``number`` new rows
    get the next numbers of that column (of each of ``groups``), in the order of the key.  No change
    touches no bucket, and makes no version.
    """
    table = open_table(spark, base)
    changes = materialize(changes.withColumn(_BUCKET, table.bucket_of(match)), "changes")
    touched = {r[0] for r in changes.select(_BUCKET).distinct().collect()}
    if not touched:
        return {}
    old = read_table(spark, base, touched)
    start = read_table(spark, base) if number else None  # the highest numbers are those of all buckets
    merged = merge_rows(old, changes.drop(_BUCKET), list(table.key), keep, number, groups, match, numbered=start)
    return _write(spark, table, merged, match)
