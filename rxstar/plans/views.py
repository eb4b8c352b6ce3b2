"""The second program's six views (V1-V7): unfiltered, INNER joins, rounded.

Their semantics differ from the dashboard on purpose: the summary average is
the unweighted mean of the per-fact averages, and top drugs rank by sold count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.distinct import MAX_BITMAPS, bitmap_parts, bitmaps_needed, bits
from ..functions.exact import as_double, ratio, round2, round2_double
from ..operators.fact import Star
from .star import star_join

VIEW_TOP_LIMIT = 10


def dashboard_summary(star: Star) -> DataFrame:
    """V1: fact rows, sold count, rounded sales, rounded unweighted AVG(avgDrug), distinct drugs/manufacturers.

    The distinct counts are of the fact's own keys, by bitmaps where these are not too many.
    """
    f = star.fact
    counted = {"dimDrug_id": "drug_count", "dimMan_id": "manufacturer_count"}
    largest = {k: star.largest_keys()[k] for k in counted}
    mapped = sum(bitmaps_needed(n) for n in largest.values()) <= MAX_BITMAPS
    keys = [p.alias(f"_{k}_{i}") for k, n in largest.items() for i, p in enumerate(bitmap_parts(F.col(k), n))] if mapped else []
    # summed as decimals: the same in any order of the rows
    averages = F.sum(F.col("avgDrug").cast("decimal(38,18)"))
    out = f.agg(
        F.count(F.lit(1)).alias("fact_rows"),
        F.sum("cntDrug").cast("long").alias("sold_count"),
        round2(F.sum("sumDrug")).alias("sales_value"),
        round2_double(ratio(averages, F.count("avgDrug"), zero=None)).alias("average_price"),
        *(keys if mapped else [F.countDistinct(k).alias(name) for k, name in counted.items()]),
    )
    if mapped:
        out = out.withColumns({name: bits([F.col(f"_{k}_{i}") for i in range(bitmaps_needed(largest[k]))]) for k, name in counted.items()})
    return out.select(
        "fact_rows", "sold_count", as_double(F.col("sales_value")).alias("sales_value"),
        as_double(F.col("average_price")).alias("average_price"), "drug_count", "manufacturer_count",
    )


def _sold_and_sales(df: DataFrame, keys: list) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("cntDrug").cast("long").alias("sold_count"),
        F.sum("sumDrug").alias("_sales"),
    )


def sales_by_month(star: Star) -> DataFrame:
    """V2: sold count and rounded sales per (year, month); callers order it."""
    df = star_join(star, {"dimTime"}, how="inner")
    agg = _sold_and_sales(df, [F.col("timeYear").alias("year_number"), F.col("timeMonth").alias("month_name")])
    return agg.select("year_number", "month_name", "sold_count", as_double(round2(F.col("_sales"))).alias("sales_value"))


def _top(star: Star, dim: str, col: str, name: str, by: str) -> DataFrame:
    df = star_join(star, {dim}, how="inner")
    agg = _sold_and_sales(df, [F.col(col).alias(name)])
    key = F.col("sold_count") if by == "count" else F.col("_sales")
    agg = agg.orderBy(key.desc(), F.col(name).asc()).limit(VIEW_TOP_LIMIT)
    return agg.select(name, "sold_count", as_double(round2(F.col("_sales"))).alias("sales_value"))


def top_drugs(star: Star) -> DataFrame:
    """V3: top 10 drugs by sold count."""
    return _top(star, "dimDrug", "drug", "drug_name", by="count")


def top_manufacturers(star: Star) -> DataFrame:
    """V4: top 10 manufacturers by sales."""
    return _top(star, "dimMan", "manufacturer", "manufacturer_name", by="sales")


def city_sales(star: Star) -> DataFrame:
    """V5: top 10 cities by sales."""
    return _top(star, "dimCity", "city", "city_name", by="sales")


def open_source_summary(metadata: DataFrame) -> DataFrame:
    """V6: metadata without the URL."""
    return metadata.select("source_key", "source_name", "records_loaded", "total_available", "fetched_at")


VIEW_NAMES = {
    "v_dashboard_summary": dashboard_summary,
    "v_sales_by_month": sales_by_month,
    "v_top_drugs": top_drugs,
    "v_top_manufacturers": top_manufacturers,
    "v_city_sales": city_sales,
}


def register_view(spark: SparkSession, name: str, star: Star, metadata: DataFrame | None = None) -> DataFrame:
    """V7 for one view: create or replace it, and scan it.  ``metadata`` is needed by the source summary alone."""
    if name in VIEW_NAMES:
        VIEW_NAMES[name](star).createOrReplaceTempView(name)
    elif name == "v_open_source_summary" and metadata is not None:
        open_source_summary(metadata).createOrReplaceTempView(name)
    else:
        raise KeyError(name)
    return spark.table(name)


def register_views(spark: SparkSession, star: Star, metadata: DataFrame | None = None) -> list[str]:
    """V7: create or replace the six views as session temp views."""
    names = []
    for name, build in VIEW_NAMES.items():
        build(star).createOrReplaceTempView(name)
        names.append(name)
    if metadata is not None:
        open_source_summary(metadata).createOrReplaceTempView("v_open_source_summary")
        names.append("v_open_source_summary")
    return names
