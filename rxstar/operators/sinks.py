"""Sinks (P1-P5): table writes, JSON rows, single objects, versioned publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.materialize import exists

_MANIFEST = "version long, path string"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Batched table write (the writer batches; no row loop)."""
    df.write.mode(mode).format(fmt).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, batchsize: int = 200, **props) -> None:
    """P1 into a database, where one exists: JDBC insert batches of ``batchsize`` rows."""
    df.write.mode("append").option("batchsize", batchsize).jdbc(url, table, properties=props)


def json_rows(df: DataFrame, keep_nulls: bool) -> DataFrame:
    """Each row as one JSON object; NULL fields kept (INCLUDE_NULL_VALUES) or dropped."""
    opts = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.to_json(F.struct(*df.columns), opts).alias("json"))


def json_single(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """The first row as one JSON object, ``{}`` when there is none (always one row)."""
    first = json_rows(df.limit(1), keep_nulls)
    return first.agg(F.coalesce(F.first("json"), F.lit("{}")).alias("json"))


def _manifest(base: str) -> str:
    return f"{base}/_manifest"


def latest_version(spark: SparkSession, base: str) -> int:
    """Newest committed version number (0 when nothing is published yet)."""
    if not exists(spark, _manifest(base)):
        return 0
    row = spark.read.schema(_MANIFEST).parquet(_manifest(base)).agg(F.max("version")).first()
    return int(row[0] or 0)


def version_path(base: str, version: int) -> str:
    return f"{base}/v{version:08d}"


def commit_version(spark: SparkSession, base: str, version: int) -> None:
    """Make a wholly written version the one that readers take."""
    row = [(version, version_path(base, version))]
    spark.createDataFrame(row, _MANIFEST).write.mode("append").parquet(_manifest(base))


def publish_version(df: DataFrame, base: str) -> str:
    """P5: write a new version directory next to the old ones, then record it in a manifest.

    The data is committed before its manifest row is appended, so a reader
    that takes the newest manifest entry never sees a half-written version,
    and a path being read is never overwritten.  Returns the new version's path.
    Versions are meant to be published by one writer at a time; what a writer that
    failed before its manifest row has left is written over.
    """
    spark = df.sparkSession
    version = latest_version(spark, base) + 1
    path = version_path(base, version)
    df.write.mode("overwrite").parquet(path)
    commit_version(spark, base, version)
    return path


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """P5 reader: the newest published version."""
    version = latest_version(spark, base)
    if not version:
        raise FileNotFoundError(f"no published version under {base}")
    return spark.read.parquet(version_path(base, version))
