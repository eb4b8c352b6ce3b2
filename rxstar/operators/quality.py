"""Integrity checks (C1-C5): database constraints re-expressed as queries.

Each check returns the violating rows (or one row per checked column), so an
empty result means the constraint holds.  All are aggregates or anti joins.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.collation import fold
from ..schemas import FACT_GRAIN, FACT_KEYS, FACT_MEASURES
from .fact import Star


def duplicates(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys that occur more than once: (table, key, n)."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        .select(F.lit(label).alias("table_name"), k.alias("key_value"), "n")
    )


def unique_dims(star: Star) -> DataFrame:
    """UNIQUE dimName per name dimension and UNIQUE timeDay; ids unique too.

    All six dimensions in one pass: one aggregate with a grouping set for each of the two keys.
    Names are compared under the star's collation.
    """
    parts = []
    for name, df in star.dims.items():
        key = F.col("timeDay").cast("string") if name == "dimTime" else fold(F.col("dimName"), star.collation)
        parts.append(df.select(F.lit(name).alias("dim"), key.alias("name"), F.col("id").cast("string").alias("id")))
    members = functools.reduce(DataFrame.unionByName, parts)
    by_id = F.grouping("id") == 0
    counts = members.groupingSets([("dim", "name"), ("dim", "id")], "dim", "name", "id").agg(
        F.count(F.lit(1)).alias("n"), by_id.alias("by_id"))
    return counts.where(F.col("n") > 1).select(
        F.when(F.col("by_id"), F.concat("dim", F.lit(".id"))).otherwise(F.col("dim")).alias("table_name"),
        F.when(F.col("by_id"), F.col("id")).otherwise(F.col("name")).alias("key_value"),
        "n",
    )


def fact_foreign_keys(star: Star) -> DataFrame:
    """Non-null fact keys without a dimension row: (fk, key_value, n).

    One scan of the fact for all six keys: a row gives a (key, id) pair for each of them, and the
    pairs are counted before the shuffle, so what is held against the dimensions is the size of these.
    """
    pairs = [F.struct(F.lit(fk).alias("fk"), F.col(fk).cast("long").alias("key_value")) for fk in FACT_KEYS]
    held = star.fact.select(F.inline(F.array(*pairs))).where(F.col("key_value").isNotNull())
    counts = held.groupBy("fk", "key_value").agg(F.count(F.lit(1)).alias("n"))
    ids = [star.dims[dim].select(F.lit(fk).alias("fk"), F.col("id").cast("long").alias("key_value")) for fk, dim in FACT_KEYS.items()]
    return counts.join(functools.reduce(DataFrame.unionByName, ids), ["fk", "key_value"], "left_anti")


def primary_key(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """PRIMARY KEY on a source table."""
    return duplicates(df, key, label)


def not_null_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """C4: one row per (table, NOT NULL column) with its count of NULLs (0 when the constraint holds)."""
    parts = []
    for label, (df, cols) in tables.items():
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        stack = ", ".join(f"'{c}', `{c}`" for c in cols)
        parts.append(counts.selectExpr(f"'{label}' AS table_name", f"stack({len(cols)}, {stack}) AS (column_name, nulls)"))
    return functools.reduce(DataFrame.unionByName, parts)


def fact_violations(star: Star, not_null: list[str] | None = None) -> DataFrame:
    """C2, C4, C5 and the fact's primary key in one scan: (constraint, key_value, n).

    A row gives one entry for each constraint that it takes part in: its six keys, its grain, its id,
    and one for each NULL in a column that may hold none.  Entries are counted before the shuffle.
    """
    columns = not_null if not_null is not None else ["id", "is_refunded", *FACT_MEASURES]

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("constraint"), value.cast("string").alias("key_value"))

    grain = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FACT_GRAIN])
    entries = [F.when(F.col(fk).isNotNull(), entry(f"FOREIGN KEY {fk}", F.col(fk))) for fk in FACT_KEYS]
    entries += [entry("UNIQUE grain", grain), F.when(F.col("id").isNotNull(), entry("PRIMARY KEY id", F.col("id")))]
    entries += [F.when(F.col(c).isNull(), entry(f"NOT NULL {c}", F.lit(None))) for c in columns]
    held = star.fact.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.constraint", "e.key_value")
    counts = held.groupBy("constraint", "key_value").agg(F.count(F.lit(1)).alias("n"))
    ids = [
        star.dims[dim].select(F.lit(f"FOREIGN KEY {fk}").alias("constraint"), F.col("id").cast("string").alias("key_value"))
        for fk, dim in FACT_KEYS.items()
    ]
    unknown = counts.join(functools.reduce(DataFrame.unionByName, ids), ["constraint", "key_value"], "left_anti")
    unique = F.col("constraint").startswith("UNIQUE") | F.col("constraint").startswith("PRIMARY")
    return unknown.where(~unique | (F.col("n") > 1))


def fact_grain(star: Star) -> DataFrame:
    """At most one fact row per grain."""
    return duplicates(star.fact, FACT_GRAIN, "factDrug")
