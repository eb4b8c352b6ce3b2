"""Upserts and load bookkeeping (U1-U3) on plain Parquet (no MERGE available)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.joins import bounded_broadcast
from ..functions.numbering import number_rows
from ..schemas import SOURCE_METADATA

# The sources the loaders record.
SOURCES = {
    "sqlserver_backup": ("SQL Server backup S (1).bak", "S (1).bak"),
    "openfda_ndc": ("FDA National Drug Code Directory", "https://api.fda.gov/drug/ndc.json"),
    "openfda_event": ("openFDA Drug Adverse Event Reports", "https://api.fda.gov/drug/event.json"),
}


def upsert_by_key(existing: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """MERGE semantics.  A matched row takes every column from ``changes`` (NULLs too);
    unmatched rows of either side are kept.  One full outer join on the key."""
    cols = [c for c in existing.columns if c not in key]
    old = existing.select(*key, *[F.col(c).alias(f"_old_{c}") for c in cols])
    new = changes.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = old.join(new, key, "full_outer")
    take_new = F.col("_new").isNotNull()
    return joined.select(
        *key, *[F.when(take_new, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in cols]
    )


def same(c: Column) -> Column:
    """Keys are equal when their values are."""
    return c


def merge_rows(
    existing: DataFrame,
    changes: DataFrame,
    key: list[str],
    keep: list[str] | None = None,
    number: str | None = None,
    groups: list[str] | None = None,
    match: Callable[[Column], Column] = same,
    numbered: DataFrame | None = None,
) -> DataFrame:
    """MERGE by key (U1, M8, M9): the columns of ``existing``, one row for each key of either side.

    - A matched row takes the change's columns (NULLs too), but for those in ``keep``.
    - Rows of ``existing`` without a change stay.
    - A change without a row is appended.  With ``number`` it gets the next numbers of that column,
      in the order of the key, after the highest of ``numbered`` (``existing`` where not given); with
      ``groups`` for each group by itself.
    - Text keys are compared by ``match`` (a collation's key); ``changes`` is unique by key.
    """
    keep = [*(keep or []), *([number] if number else [])]
    text = {k for k in key if isinstance(existing.schema[k].dataType, T.StringType) and k not in (groups or [])}
    new = changes.select(F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns])

    def on(side: str) -> Column:
        tests = [(match(F.col(k)) if k in text else F.col(k)) == (match(F.col(f"{side}{k}")) if k in text else F.col(f"{side}{k}")) for k in key]
        return reduce(and_, tests)

    known = [c for c in existing.columns if c in changes.columns and c not in keep and c not in key]
    taken = existing.join(new, on("_new_"), "left").select(
        *[F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in known else F.col(c) for c in existing.columns]
    )
    old = existing.select(*[F.col(k).alias(f"_old_{k}") for k in key])
    fresh = changes.join(old, on("_old_"), "left_anti")
    if number:
        highest = (numbered if numbered is not None else existing).groupBy(*(groups or [])).agg(F.max(number).alias("_start"))
        if groups:
            start, n = F.col("_start"), highest.count()
            fresh = fresh.join(bounded_broadcast(highest, n), groups, "left").fillna({"_start": 0})
        else:
            start = int(highest.first()[0] or 0)
        order = [k for k in key if k not in (groups or [])]
        fresh = number_rows(fresh, order, number, start, existing.schema[number].dataType, groups)
    fill = [F.col(c) if c in fresh.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in existing.columns]
    return taken.unionByName(fresh.select(*fill))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """INSERT OR REPLACE in ``order``: per key the whole last row wins.

    Two phases for each order column: the largest value of each key (a hash
    aggregate of key and number with map-side combine, which reads no other
    column), then the rows that have it, by a semi-join on key and value.  The
    join is dealt by both, so a key that a third of all rows have is spread.
    With several order columns the phases run on keys and order alone, and
    whole rows are dealt once, by the key and the order found for it.
    ``order`` must be unique per key (a full tie-break); NULL keys are one key,
    and a key whose order values are all NULL keeps its rows.
    """
    rows, best = df, df.select(*key, *order)
    for n, column in enumerate(order):
        known = order[:n]
        last = best.groupBy(*[F.col(c).alias(f"_{c}") for c in (*key, *known)]).agg(F.max(column).alias(f"_{column}"))
        if column != order[-1]:
            best = _at(best, last, [*key, *known, column])
    return _at(rows, last, [*key, *order]).select(*key, *[c for c in df.columns if c not in key])


def _at(df: DataFrame, last: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``df`` that ``last`` names in its columns of the same names after a ``_``."""
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in reversed(columns)])
    return df.join(last, on, "left_semi")


def bookkeeping(source_key: str, loaded: DataFrame, total: DataFrame | None, fetched_at: str) -> DataFrame:
    """One metadata row for a load: records read before key dedupe, total available, run time.

    ``fetched_at`` is an argument (the run's time), never the clock inside a task.
    """
    name, url = SOURCES[source_key]
    counts = loaded.agg(F.count(F.lit(1)).cast("long").alias("records_loaded"))
    total_col = total.select(F.first("total_available")).scalar() if total is not None else F.lit(None)
    return counts.select(
        F.lit(source_key).alias("source_key"),
        F.lit(name).alias("source_name"),
        F.lit(url).alias("source_url"),
        "records_loaded",
        total_col.cast("long").alias("total_available"),
        F.lit(fetched_at).alias("fetched_at"),
    )


def metadata_seed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Literal metadata rows (VALUES) with the declared schema."""
    return spark.createDataFrame(rows, SOURCE_METADATA)
