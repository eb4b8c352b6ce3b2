"""Compare rows within buckets, in blocks of bounded size.

A bucket of more than ``cap`` rows is cut into chunks by a hash of the row, and every pair of
chunks becomes one unit of work, so no task gathers a large bucket.  Every pair of rows of one
bucket meets in exactly one unit; the unit's output is up to the caller and should be linear in
its rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.joins import bounded_broadcast
from .common import store


def units(rows: DataFrame, bucket: list[str], ident: str, cap: int) -> DataFrame:
    """``rows`` with _i, _j (the chunks of the unit) and _side, dealt and sorted by unit.

    The list of large buckets is broadcast within a checked bound, so that rows are shuffled once.
    Where _i = _j every two rows are to be compared; else rows of side 0 with rows of side 1.
    """
    big = rows.groupBy(*bucket).count().filter(F.col("count") > cap)
    big = store(big.withColumn("_chunks", F.ceil(F.col("count") / cap).cast("int")).drop("count"), "large-buckets")
    n = F.coalesce("_chunks", F.lit(1))
    own = F.pmod(F.xxhash64(F.col(ident)), F.col("_chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    cut = rows.join(bounded_broadcast(big, big.count()), bucket, "left").withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", other)
    cut = cut.select(
        *rows.columns,
        F.least("_own", "_other").alias("_i"),
        F.greatest("_own", "_other").alias("_j"),
        (F.col("_own") > F.col("_other")).cast("int").alias("_side"),
    )
    keys = [*bucket, "_i", "_j"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, *keys).sortWithinPartitions(*keys, "_side")


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every one of ``size`` rows the smallest row that the links a-b reach."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root
