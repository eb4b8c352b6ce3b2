"""Scans of the driver's Parquet tables with an explicit projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when a scan yields fewer splits than the cluster's parallelism.

    A large input already arrives in many splits (one per file block or row
    group) and is left alone, so this adds no shuffle at scale; a small file
    written as one row group would otherwise run every downstream narrow
    operator (parse, broadcast joins, partial aggregation) in one task.
    Rows are placed by a hash of all their columns: deterministic when a task
    is retried, and only identical rows share a partition (no hot key).
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want, F.xxhash64(*df.columns))
    return df


def read_table(
    spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, spread_out: bool = False
) -> DataFrame:
    """Read one table; the projection reaches the Parquet scan as its ReadSchema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    return spread(df) if spread_out else df
