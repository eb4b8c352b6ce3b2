"""Dashboard aggregates, rankings and detail.

Sums stay DECIMAL and exact, ratios are one division of two exact sums, and values leave as
DOUBLE only in the final select.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import blank_to_label
from ..functions.collation import BINARY, fold
from ..functions.distinct import MAX_BITMAPS, bitmap_parts, bitmaps_needed, bits
from ..functions.exact import as_double, ratio, round2, round2_double
from ..operators.fact import Star
from .filters import Filters
from .star import DIM_COLUMNS, filtered, star_join

# Fixed values of the reference's dashboard.
REFUNDED_LABEL = "Refundowane"
NOT_REFUNDED_LABEL = "Bez refundacji"
RANK_LIMITS = {"top_drugs": 10, "top_manufacturers": 10, "top_cities": 10, "top_conditions": 8, "top_drug_types": 4}
RECENT_LIMIT = 100
SOURCE_TOP_LIMIT = 10

# Ranking label -> (dimension, star column).
LABELS = {
    "drug": ("dimDrug", "drug"),
    "manufacturer": ("dimMan", "manufacturer"),
    "city": ("dimCity", "city"),
    "condition": ("dimConTh", "condition"),
    "drug_type": ("dimDrugType", "drug_type"),
    "month": ("dimTime", "timeMonth"),
}


def _sales_measures() -> list:
    """total_sales, transactions and weighted avg_price, still exact (decimal / long)."""
    sales = F.coalesce(F.sum("sumDrug"), F.lit(0).cast("decimal(38,2)"))
    cnt = F.coalesce(F.sum("cntDrug"), F.lit(0).cast("long"))
    return [
        sales.alias("total_sales"),
        cnt.cast("long").alias("transactions"),
        ratio(F.sum("sumDrug"), F.sum("cntDrug")).alias("avg_price"),
    ]


def _doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[as_double(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def kpi_summary(star: Star, filters: Filters | None = None) -> DataFrame:
    """G1: one row of ten measures, also for an empty selection.

    The three distinct counts are of dimension ids, as after the LEFT JOINs: a fact key without a
    dimension row (check C2) does not count.  The fact's ids and each dimension's ids are bitmaps,
    ANDed, so nothing is joined or expanded for them; dimensions of too many ids for that take a
    distinct aggregate over the join.
    """
    counted = {"dimDrug": "drug_count", "dimMan": "manufacturer_count", "dimCity": "city_count"}
    mapped = {dim: star.largest(dim) for dim in counted if bitmaps_needed(star.largest(dim)) <= MAX_BITMAPS}
    if sum(bitmaps_needed(n) for n in mapped.values()) > MAX_BITMAPS:
        mapped = {}
    df = filtered(star, filters, {"dimTime"} | (set(counted) - set(mapped)))
    refunded = F.sum(F.when(F.col("is_refunded") == 1, F.col("cntDrug")).otherwise(F.lit(0)))
    out = df.agg(
        F.count(F.lit(1)).alias("fact_groups"),
        *_sales_measures()[:3],
        ratio(refunded * F.lit(100), F.sum("cntDrug")).alias("refund_rate"),
        *[F.countDistinct(DIM_COLUMNS[d][1]["dimName"]).alias(counted[d]) for d in counted if d not in mapped],
        F.min("timeDay").alias("date_from"),
        F.max("timeDay").alias("date_to"),
        *[p.alias(f"_{dim}_{i}") for dim, n in mapped.items() for i, p in enumerate(bitmap_parts(F.col(f"{dim}_id"), n))],
    )
    out = _present(star, out, mapped).withColumns({counted[d]: bits(_parts(d, n)) for d, n in mapped.items()})
    names = ["fact_groups", "total_sales", "transactions", "avg_price", "refund_rate", *counted.values(), "date_from", "date_to"]
    return _doubles(out.select(*names), ["total_sales", "avg_price", "refund_rate"])


def _parts(dim: str, largest: int) -> list[Column]:
    return [F.col(f"_{dim}_{i}") for i in range(bitmaps_needed(largest))]


def _present(star: Star, row: DataFrame, mapped: dict[str, int]) -> DataFrame:
    """``row`` (one row) with each dimension's bitmaps ANDed with those of the ids that the dimension has."""
    if not mapped:
        return row
    fact = F.struct(*[p for dim, n in mapped.items() for p in _parts(dim, n)])
    known = []
    for dim, n in mapped.items():
        own = star.dims[dim].agg(F.struct(*[p.alias(str(i)) for i, p in enumerate(bitmap_parts(F.col("id"), n))])).scalar()
        known += [own[str(i)].alias(f"_{dim}_{i}") for i in range(bitmaps_needed(n))]
    rest = [c for c in row.columns if not c.startswith("_")]
    two = row.select(*rest, F.explode(F.array(fact, F.struct(*known))).alias("_m"))
    both = [F.bitmap_and_agg(F.col(f"_m._{dim}_{i}")).alias(f"_{dim}_{i}") for dim, n in mapped.items() for i in range(bitmaps_needed(n))]
    return two.agg(*[F.first(c).alias(c) for c in rest], *both)


def monthly_sales(star: Star, filters: Filters | None = None) -> DataFrame:
    """Sales, transactions and weighted average price per YYYY-MM, in month order."""
    df = filtered(star, filters, {"dimTime"})
    out = df.groupBy(F.col("timeMonth").alias("label")).agg(*_sales_measures()).orderBy(F.col("label").asc_nulls_first())
    return _doubles(out, ["total_sales", "avg_price"])


def ranked(star: Star, label: str, filters: Filters | None = None, order_key: str = "total_sales",
           limit: int | None = 10) -> DataFrame:
    """Group by a dimension label, order by ``order_key`` desc then label, keep ``limit``.

    The label is the second sort key so equal totals rank deterministically.
    ORDER BY + LIMIT plans as TakeOrderedAndProject: each task keeps its own
    top ``limit`` and only those rows move, so no full sort happens.
    """
    dim, col = LABELS[label]
    df = filtered(star, filters, {dim})
    agg = df.groupBy(F.col(col).alias("label")).agg(*_sales_measures())
    agg = agg.orderBy(F.col(order_key).desc(), F.col("label").asc_nulls_first())
    if limit is not None:
        agg = agg.limit(limit)
    return _doubles(agg, ["total_sales", "avg_price"])


def top_drugs(star: Star, filters: Filters | None = None) -> DataFrame:
    """G4."""
    return ranked(star, "drug", filters, limit=RANK_LIMITS["top_drugs"])


def top_manufacturers(star: Star, filters: Filters | None = None) -> DataFrame:
    """G5."""
    return ranked(star, "manufacturer", filters, limit=RANK_LIMITS["top_manufacturers"])


def top_cities(star: Star, filters: Filters | None = None) -> DataFrame:
    """G6."""
    return ranked(star, "city", filters, limit=RANK_LIMITS["top_cities"])


def top_conditions(star: Star, filters: Filters | None = None) -> DataFrame:
    """G7."""
    return ranked(star, "condition", filters, limit=RANK_LIMITS["top_conditions"])


def top_drug_types(star: Star, filters: Filters | None = None, limit: int = RANK_LIMITS["top_drug_types"]) -> DataFrame:
    """G8 (the limit is a parameter: the SQL file keeps all types)."""
    return ranked(star, "drug_type", filters, limit=limit)


def drug_type_split(star: Star, filters: Filters | None = None) -> DataFrame:
    """Every drug type with its average price, by sales."""
    return ranked(star, "drug_type", filters, limit=None)


def refund_split(star: Star, filters: Filters | None = None) -> DataFrame:
    """Totals per refund flag, labelled, refunded first."""
    df = filtered(star, filters)
    agg = df.groupBy("is_refunded").agg(*_sales_measures()[:2]).orderBy(F.col("is_refunded").desc())
    label = F.when(F.col("is_refunded") == 1, F.lit(REFUNDED_LABEL)).otherwise(F.lit(NOT_REFUNDED_LABEL))
    return _doubles(agg.select(label.alias("label"), "total_sales", "transactions"), ["total_sales"])


def refund_share(split: DataFrame) -> DataFrame:
    """Refunded / all transactions x 100 over a refund split; 0 when there are none."""
    refunded = F.sum(F.when(F.col("label") == REFUNDED_LABEL, F.col("transactions")).otherwise(F.lit(0)))
    total = F.sum(F.when(F.col("label").isin(REFUNDED_LABEL, NOT_REFUNDED_LABEL), F.col("transactions")).otherwise(F.lit(0)))
    out = split.agg(ratio(refunded * F.lit(100), total).alias("refund_share"))
    return _doubles(out, ["refund_share"])


def newest_part(star: Star, filters: Filters, limit: int) -> Star:
    """The star with the newest years of the fact that hold at least ``limit`` rows of the selection.

    Years are taken from the newest backwards, each time twice as many; rows without a day come
    last, so the whole fact remains where all years together hold fewer.  Without filters the
    stored row counts decide; else a job looks for ``limit`` rows, and stops when it has them.
    """
    if "fact_year" not in star.fact.columns or filters.year is not None:
        return star
    rows = star.year_rows()
    years = sorted((y for y in rows if y is not None), reverse=True)
    plain = not filters.active()
    taken = 1
    while taken <= len(years) and limit > 0:
        oldest = years[taken - 1]
        part = replace(star, fact=star.fact.where(F.col("fact_year") >= F.lit(oldest)))
        if plain:
            enough = sum(rows[y] for y in years[:taken]) >= limit
        else:
            dated = filtered(part, filters, {"dimTime"}).where(F.col("timeDay").isNotNull())
            enough = dated.limit(limit).count() >= limit
        if enough:
            return part
        taken = taken + 1 if plain else taken * 2
    return star


def recent_records(star: Star, filters: Filters | None = None, limit: int = RECENT_LIMIT) -> DataFrame:
    """O1: the latest fact rows with all names, two measures rounded to 2 places.

    Only the newest years are read: the fact is partitioned by the year of its day, so the rows of
    the newest years that hold ``limit`` rows come before all others (``newest_part``).

    The top ``limit`` rows are chosen on the fact joined only to dimTime (for
    the order) and to the dimensions the filters need; the other names are
    then joined to those ``limit`` rows alone.  Ids are unique, so the LEFT
    JOINs after the limit neither add nor drop rows.
    """
    filters = filters or Filters()
    order = [F.col("timeDay").desc_nulls_last(), F.col("id").desc()]
    top = filtered(newest_part(star, filters, limit), filters, {"dimTime"}).orderBy(*order).limit(limit)
    done = filters.dimensions() | {"dimTime"}
    rest = replace(star, fact=top)
    df = star_join(rest, set(LABELS[k][0] for k in LABELS) - done)
    out = df.select(
        "id",
        F.col("timeDay").alias("sale_date"),
        "city",
        "condition",
        "drug",
        "drug_type",
        "manufacturer",
        "is_refunded",
        "cntDrug",
        as_double(round2(F.col("sumDrug"))).alias("total_sales"),
        as_double(round2_double(F.col("avgDrug"))).alias("avg_price"),
    )
    return out.orderBy(F.col("sale_date").desc_nulls_last(), F.col("id").desc())


def top_labels(df: DataFrame, column: str, count_name: str, limit: int = SOURCE_TOP_LIMIT,
               collation: str = BINARY) -> DataFrame:
    """O2/O3: blank -> 'Unknown', count per label, count desc then label, first ``limit``.

    Labels that the collation takes for equal are one group (as under the
    reference databases' default collation), shown by the smallest spelling;
    spellings are counted first, so the text minimum is over the vocabulary.
    """
    agg = df.groupBy(blank_to_label(F.col(column)).alias("label")).agg(F.count(F.lit(1)).alias(count_name))
    if collation != BINARY:
        agg = agg.groupBy(fold(F.col("label"), collation).alias("_k")).agg(F.min("label").alias("label"), F.sum(count_name).alias(count_name))
        agg = agg.drop("_k")
    return agg.orderBy(F.col(count_name).desc(), F.col("label").asc()).limit(limit)


def top_labelers(ndc: DataFrame, collation: str = BINARY) -> DataFrame:
    """O2 over the stored NDC products."""
    return top_labels(ndc, "labeler_name", "products", collation=collation)


def top_reactions(events: DataFrame, collation: str = BINARY) -> DataFrame:
    """O3 over the stored adverse events."""
    return top_labels(events, "reaction", "reports", collation=collation)


def source_summary(metadata: DataFrame, ndc: DataFrame, events: DataFrame) -> DataFrame:
    """Metadata rows by key, each with the stored NDC and event row counts (scalar subqueries)."""
    ndc_count = ndc.select(F.count(F.lit(1))).scalar()
    event_count = events.select(F.count(F.lit(1))).scalar()
    cols = ["source_key", "source_name", "source_url", "records_loaded", "total_available", "fetched_at"]
    return metadata.select(*cols, ndc_count.alias("ndc_count"), event_count.alias("event_count")).orderBy("source_key")


def filter_values(star: Star, dim: str) -> DataFrame:
    """Sorted names of one dimension."""
    return star.dims[dim].select("dimName").orderBy("dimName")


def filter_years(star: Star) -> DataFrame:
    """Distinct non-null years of the time dimension, sorted."""
    return star.dims["dimTime"].select("timeYear").where(F.col("timeYear").isNotNull()).distinct().orderBy("timeYear")
