"""Dashboard requests -> DataFrames: the reference's API routes as plans (query lifecycle, SURVEY §3.1).

A request is a path and a parameter mapping (name -> list of values, as a web
framework parses a query string).  ``answer`` validates the filters (Q9) and
returns the lazily built DataFrame(s); nothing runs until the caller collects
the (small) result.  Serving it over HTTP is outside this library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.fact import Star
from . import dashboard as D
from .filters import Filters


@dataclass
class Sources:
    """The stored openFDA tables the source routes read."""

    metadata: DataFrame
    ndc: DataFrame
    events: DataFrame


FILTERED_ROUTES = {
    "/api/summary": D.kpi_summary,
    "/api/timeseries": D.monthly_sales,
    "/api/top-drugs": D.top_drugs,
    "/api/manufacturers": D.top_manufacturers,
    "/api/cities": D.top_cities,
    "/api/conditions": D.top_conditions,
    "/api/refunds": D.refund_split,
    "/api/drug-types": D.top_drug_types,
    "/api/records": D.recent_records,
}
SOURCE_ROUTES = {
    "/api/source-summary": lambda s: D.source_summary(s.metadata, s.ndc, s.events),
    "/api/source-labelers": lambda s: D.top_labelers(s.ndc),
    "/api/source-reactions": lambda s: D.top_reactions(s.events),
}
FILTER_LISTS = {
    "cities": "dimCity",
    "conditions": "dimConTh",
    "drugs": "dimDrug",
    "types": "dimDrugType",
    "manufacturers": "dimMan",
}


def answer(path: str, params: dict[str, list[str]] | None, star: Star, sources: Sources | None = None):
    """The DataFrame for one route (a dict of DataFrames for ``/api/filters``).

    Raises KeyError for an unknown route and ValueError for a non-integer
    year or refunded parameter, before any plan is built.
    """
    if path in FILTERED_ROUTES:
        return FILTERED_ROUTES[path](star, Filters.from_params(params))
    if path == "/api/filters":  # the reference ignores parameters here
        lists = {key: D.filter_values(star, dim) for key, dim in FILTER_LISTS.items()}
        lists["years"] = D.filter_years(star)
        return lists
    if path in SOURCE_ROUTES:
        if sources is None:
            raise ValueError(f"{path} needs the stored source tables")
        return SOURCE_ROUTES[path](sources)
    raise KeyError(path)
