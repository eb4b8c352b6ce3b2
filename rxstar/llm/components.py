"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join on the vertex; a vertex that holds a third
of all links is split by AQE's skew join.  Links are written to the shared folder after each
round, so the lineage stays short and a lost executor costs one step.  Only two numbers of each
round (rows and checksum) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import store

#: Rounds needed are about the logarithm of the longest path; more than this means a fault.
MAX_ROUNDS = 60


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``links`` (columns u, v: long, any direction).

    The component is the smallest vertex that links reach.  Null ends and self-links are
    ignored; repeated links count once; no links give an empty table.
    """
    down = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    )
    down = store(down.distinct(), "links")
    mark = _mark(down)
    for _ in range(MAX_ROUNDS if mark[0] else 0):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = down.select(F.col("v").alias("u"), F.col("u").alias("w"))  # w: the larger neighbours of u
        large = up.join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        down = store(small, "links")
        before, mark = mark, _mark(down)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # settled: every vertex but the smallest has one link, to the smallest
    return down.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        down.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
