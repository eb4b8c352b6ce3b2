"""Dense row numbering without a global single-partition window.

``row_number() OVER (ORDER BY k)`` with no PARTITION BY moves every row into
one task.  Instead: range-partition on the keys, sort inside each partition,
take each row's position in its partition, and add the row count of all
earlier partitions (a table with one row per partition and group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from .joins import bounded_broadcast
from .materialize import materialize

#: Counts that are brought to the driver to make the offsets.
FEW_COUNTS = 50_000


def number_rows(
    df: DataFrame,
    order_cols: list[str],
    id_col: str = "id",
    start: Column | int = 0,
    id_type: T.DataType = T.LongType(),
    group_cols: list[str] | None = None,
) -> DataFrame:
    """Add ``id_col`` = start + 1-based position of the row in ``order_cols`` order.

    With ``group_cols`` the position restarts in every group (like
    ``row_number() OVER (PARTITION BY g ORDER BY k)``), but a large group is
    still spread over many tasks.  ``start`` may be a column of ``df`` (a
    per-group starting id).  The keys must be unique within a group for the
    numbering to be deterministic.  The tagged rows are written once to the
    shared folder (``spark.checkpoint.dir``) and read back, so a lost executor
    cannot re-run the range partitioning differently from the counts the
    offsets were taken from.
    """
    groups = list(group_cols or [])
    keys = groups + list(order_cols)
    tagged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # Position of the row inside its partition (the low 33 bits of the id).
    tagged = tagged.withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_mid")
    tagged = materialize(tagged, "numbered")
    # The per-(partition, group) counts give each row's offset: rows of its group in earlier
    # partitions, minus rows of earlier groups in its own partition (which come first there,
    # because rows are sorted).
    offsets = _offsets(tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n")), groups)
    start_col = start if isinstance(start, Column) else F.lit(start)
    numbered = tagged.join(offsets, ["_pid", *groups]).withColumn(
        id_col, (start_col + F.col("_offset") + F.col("_pos") + 1).cast(id_type)
    )
    return numbered.drop("_pid", "_pos", "_offset")


def _offsets(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(_pid, groups, _offset): made here while the counts are few, else by windows over them.

    Without groups there is a count for each partition; groups may be many, so what is sent is
    bounded, and beyond that the table is broadcast only if its counted size allows it.
    """
    schema = T.StructType([*[counts.schema[c] for c in ("_pid", *groups)], T.StructField("_offset", T.LongType())])
    few = counts.limit(FEW_COUNTS + 1).collect()
    if len(few) <= FEW_COUNTS:
        def order(row) -> tuple:  # the order of the rows: NULL groups first
            return tuple((row[g] is not None, row[g]) for g in groups)

        of_group: dict[tuple, int] = {}
        of_pid: dict[int, int] = {}
        rows = []
        for row in sorted(few, key=lambda r: (r["_pid"], order(r))):
            key = order(row)
            before = of_group.get(key, 0) - (of_pid.get(row["_pid"], 0) if groups else 0)
            rows.append((row["_pid"], *[row[g] for g in groups], before))
            of_group[key] = of_group.get(key, 0) + row["_n"]
            of_pid[row["_pid"]] = of_pid.get(row["_pid"], 0) + row["_n"]
        return F.broadcast(counts.sparkSession.createDataFrame(rows, schema))
    earlier_parts = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier_parts), F.lit(0))
    if groups:
        earlier_groups = Window.partitionBy("_pid").orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
        offset = offset - F.coalesce(F.sum("_n").over(earlier_groups), F.lit(0))
    offsets = materialize(counts.select("_pid", *groups, offset.alias("_offset")), "offsets")
    text = [F.octet_length(g) for g in groups if isinstance(counts.schema[g].dataType, T.StringType)]
    size = offsets.agg(F.count(F.lit(1)), F.coalesce(sum((F.sum(t) for t in text), F.lit(0)), F.lit(0))).first()
    return bounded_broadcast(offsets, *size)
