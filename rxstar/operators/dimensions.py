"""Dimensions with surrogate keys (M1-M9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.collation import BINARY, fold, representatives
from ..functions.numbering import number_rows
from .upsert import merge_rows


def distinct_names(staged: DataFrame, column: str, collation: str = BINARY) -> DataFrame:
    """M1-M5: distinct non-null values of one staging column, as ``dimName``."""
    names = staged.select(F.col(column).alias("dimName")).where(F.col("dimName").isNotNull())
    return representatives(names, [], "dimName", collation)


def time_attributes(ts: F.Column) -> list:
    """M6 attributes: day, weekday (Sunday = 1), ISO week, YYYY-MM, year."""
    return [
        F.to_date(ts).alias("timeDay"),
        F.dayofweek(ts).alias("timeWeekDay"),
        F.weekofyear(ts).alias("timeWeekNum"),
        F.date_format(ts, "yyyy-MM").alias("timeMonth"),
        F.year(ts).alias("timeYear"),
    ]


def distinct_days(staged: DataFrame, column: str = "Sale_Timestamp") -> DataFrame:
    """M6 without ids: one row per distinct day of a timestamp column."""
    return staged.where(F.col(column).isNotNull()).select(*time_attributes(F.col(column))).distinct()


def with_surrogate_keys(values: DataFrame, order_col: str, start: int = 0) -> DataFrame:
    """M7: ids start+1, start+2, ... in ``order_col`` order (distributed numbering)."""
    numbered = number_rows(values, [order_col], id_col="id", start=start, id_type=T.IntegerType())
    return numbered.select("id", *[c for c in values.columns])


def upsert_names(existing: DataFrame | None, names: DataFrame, collation: str = BINARY) -> DataFrame:
    """M8: existing names keep their id and spelling; new names are appended after the current maximum."""
    if existing is None:
        return with_surrogate_keys(names, "dimName")
    return merge_rows(existing, names, ["dimName"], number="id", match=lambda c: fold(c, collation))


def upsert_days(existing: DataFrame | None, days: DataFrame) -> DataFrame:
    """M9: a known day keeps its id and takes the new attributes; new days are appended."""
    if existing is None:
        return with_surrogate_keys(days, "timeDay")
    return merge_rows(existing, days, ["timeDay"], number="id")
