"""Star join (Q1): fact LEFT JOIN only the dimensions a query uses.

Spark cannot drop an unused LEFT JOIN (it does not know the dimension id is
unique), so the builder joins on demand.  Joining fewer dimensions never
changes the row count because dimension ids are unique (check C1).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..functions.collation import fold
from ..operators.fact import Star
from .filters import Filters

# Dimension -> (fact key, columns it contributes under their dashboard names).
DIM_COLUMNS = {
    "dimCity": ("dimCity_id", {"dimName": "city"}),
    "dimConTh": ("dimConTh_id", {"dimName": "condition"}),
    "dimDrug": ("dimDrug_id", {"dimName": "drug"}),
    "dimDrugType": ("dimDrugType_id", {"dimName": "drug_type"}),
    "dimMan": ("dimMan_id", {"dimName": "manufacturer"}),
    "dimTime": ("dimTime_id", {"timeDay": "timeDay", "timeMonth": "timeMonth", "timeYear": "timeYear"}),
}
ALL_DIMS = set(DIM_COLUMNS)


def star_join(star: Star, needed: set[str], how: str = "left") -> DataFrame:
    """Fact joined to each dimension in ``needed`` on its id (broadcast when its size allows)."""
    df = star.fact
    for dim in [d for d in DIM_COLUMNS if d in needed]:
        key, cols = DIM_COLUMNS[dim]
        side = star.dim(dim).select(F.col("id").alias(f"_{dim}_id"), *[F.col(c).alias(a) for c, a in cols.items()])
        df = df.join(side, F.col(key) == F.col(f"_{dim}_id"), how).drop(f"_{dim}_id")
    return df


def filtered(star: Star, filters: Filters | None, needed: set[str] = frozenset()) -> DataFrame:
    """Q1 + Q9: star frame with the dimensions for ``needed`` and for the filters, filtered.

    A year filter is also applied to the fact's ``fact_year`` partition column
    (the year of the fact's day, written at load), so the fact scan prunes
    partitions; the dimension predicate keeps the reference's semantics.  A
    name is resolved to its id first (a dimension holds a name once), so the
    fact scan skips the row groups without that id.
    """
    filters = filters or Filters()
    for dim, name in filters.members().items():
        same = fold(F.col("dimName"), star.collation) == fold(F.lit(name), star.collation)
        ident = star.dims[dim].where(same).agg(F.max("id")).scalar()
        star = replace(star, fact=star.fact.where(F.col(DIM_COLUMNS[dim][0]) == ident))
    df = star_join(star, set(needed) | filters.dimensions())
    if filters.year is not None and "fact_year" in star.fact.columns:
        df = df.where(F.col("fact_year") == F.lit(filters.year))
    return df.where(filters.predicate(star.collation))
