"""Registered queries: name -> (spark, sf_dir) -> DataFrame, one per operator of the survey.

Sales queries read the star loaded from mapping A (dashboard, views, checks)
or run the load themselves (staging, dimensions, fact).  openFDA queries read
the pages landed from mapping J.  Every query reads the test tables, or data
Spark derived from them, in whole.
"""

from __future__ import annotations

import functools
import hashlib
import os
from dataclasses import replace
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.collation import LCASE
from .functions.exact import as_double
from .functions.once import once
from .operators import quality as C
from .operators import sinks as P
from .operators.buckets import create_table, merge_table, read_table as read_buckets
from .operators.dimensions import distinct_days, distinct_names, upsert_days, upsert_names, with_surrogate_keys
from .operators.fact import Star, key_lookup, lookup_rejects, run_etl
from .operators.load import LoadedSource, load_source
from .operators.staging import load_rejects, stage_rejects, stage_sales, typed_columns
from .operators.upsert import bookkeeping
from .plans import dashboard as D
from .plans import views as V
from .plans.catalog import export_tables, register_star
from .plans.filters import Filters
from .plans.star import ALL_DIMS, star_join
from .plans.warehouse import open_table, read_star, sales_star, warehouse_root, write_star
from .schemas import NAME_DIMENSIONS
from .sources import openfda as S
from .sources.fixtures import broken_raw_sales, landed_raw_sales as raw_sales
from .sources.landing import broken_event_pages, landed_page_set, page_schema
from .sources.raw import land_csv, scan_import_raw, scan_import_raw_checked, scan_projection
from .sources.tables import read_table
from .operators.sinks import latest_version
from .streaming.incremental import compact_events, current_events, snapshot_and_tail, start_event_stream

Query = Callable[[SparkSession, str], DataFrame]

# Fixed run times recorded by the bookkeeping (an argument, never the clock).
FIRST_RUN = "2026-05-31T08:48:56+00:00"
SECOND_RUN = "2026-06-01T09:00:00+00:00"

# Filter values used by the single-filter queries (values present in mapping A).
FILTER_CASES = {
    "filter_city": Filters(city="NATION_3"),
    "filter_condition": Filters(condition="1-URGENT"),
    "filter_drug": Filters(drug="small ring"),
    "filter_type": Filters(type="ECONOMY"),
    "filter_manufacturer": Filters(manufacturer="Brand#2"),
    "filter_year": Filters(year=1997),
    "filter_refunded": Filters(refunded=1),
}
CI_FILTER_CASES = {
    "filter_city_ci": Filters(city="eUROPE"),
    "filter_condition_ci": Filters(condition="Machinery"),
    "filter_drug_ci": Filters(drug="Purchase"),
    "filter_type_ci": Filters(type="event"),
    "filter_manufacturer_ci": Filters(manufacturer="events co"),
}
COMBINED_PARAMS = {"city": [" NATION_3 "], "year": ["1997"], "refunded": ["0"], "drug": [""], "other": ["x"]}
EMPTY_FILTER = Filters(city="NO SUCH CITY")


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    return f"{warehouse_root(spark)}/{name}-{tag}"


def fact_output(fact: DataFrame) -> DataFrame:
    """The fact table as the reference stores it (DOUBLE measures)."""
    return fact.select(
        "id", "dimCity_id", "dimConTh_id", "dimDrug_id", "dimDrugType_id", "dimMan_id", "dimTime_id", "is_refunded",
        F.col("cntDrug").cast("long").alias("cntDrug"),
        *[as_double(F.col(c)).alias(c) for c in ("sumDrug", "avgDrug", "minDrug", "maxDrug")],
    )


def _fact_double(spark, d):
    """Sums and averages of DOUBLE prices, given to the places that do not depend on the order of summation."""
    out = fact_output(run_etl(raw_sales(spark, d, "B"), measure="double").fact)
    places = {"sumDrug": "decimal(20,6)", "avgDrug": "decimal(38,8)"}
    return out.withColumns({c: as_double(F.col(c).cast(t)) for c, t in places.items()})


def _staged_out(df: DataFrame) -> DataFrame:
    return df.withColumn("Price", as_double(F.col("Price")))


def _star(spark, d):
    return sales_star(spark, d, "A")


def _dash(fn, filters: Filters | None = None) -> Query:
    return lambda spark, d: fn(_star(spark, d), filters)


# --- openFDA tables -----------------------------------------------------------
def pages(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return S.read_pages(spark, landed_page_set(spark, d, kind), kind)


def ndc_records(spark, d):
    return S.flatten_ndc(S.records(pages(spark, d, "ndc")))


def event_records(spark, d):
    return S.flatten_events(S.records(pages(spark, d, "event")))


def load_ndc(spark, d, fetched_at: str = FIRST_RUN) -> LoadedSource:
    """The NDC products: all landed records, keep-last per product_ndc in insert order, and the metadata row."""
    return load_source(pages(spark, d, "ndc"), S.flatten_ndc, "openfda_ndc", ["product_ndc"], fetched_at)


def load_events(spark, d, fetched_at: str = FIRST_RUN) -> LoadedSource:
    """The adverse events: all landed reports, keep-last per safetyreportid in insert order, and the metadata row."""
    return load_source(pages(spark, d, "event"), S.flatten_events, "openfda_event", ["safetyreportid"], fetched_at)


def source_metadata(spark, d, fetched_at: str = FIRST_RUN, only_open: bool = False) -> DataFrame:
    """U3 for all three sources of one run."""
    out = load_ndc(spark, d, fetched_at).metadata.unionByName(load_events(spark, d, fetched_at).metadata)
    if not only_open:
        out = bookkeeping("sqlserver_backup", _star(spark, d).fact, None, fetched_at).unionByName(out)
    return out


#: The stored table of each loaded source, and its load.
LOADS = {"source_ndc_products": load_ndc, "source_drug_events": load_events}


def _loaded(spark, d, name: str) -> tuple[DataFrame, DataFrame]:
    """Stored table and metadata row of one source, which is read once for both."""
    return open_table(spark, d, name, lambda: (lambda load: (load.current, load.metadata))(LOADS[name](spark, d)))


def stored(spark, d, name: str) -> DataFrame:
    """Stored source table (source_ndc_products, source_drug_events, source_metadata); a source is loaded when its table is first read."""
    if name in LOADS:
        return _loaded(spark, d, name)[0]

    def all_metadata() -> tuple[DataFrame, None]:
        sales = bookkeeping("sqlserver_backup", _star(spark, d).fact, None, FIRST_RUN)
        return functools.reduce(DataFrame.unionByName, [_loaded(spark, d, n)[1] for n in LOADS], sales), None

    return open_table(spark, d, name, all_metadata)[0]


def _broken_raw(spark, d) -> tuple[DataFrame, DataFrame]:
    """Mapping M landed as CSV lines, some of them broken: the rows, and the rejected lines."""
    path = _scratch(spark, d, "import_raw_broken")
    once(_LANDED_CSV, path, lambda: broken_raw_sales(spark, d, "M", path))
    return scan_import_raw_checked(spark, path, header=False)


def _broken_pages(spark, d) -> tuple[DataFrame, DataFrame]:
    return S.read_pages_checked(spark, broken_event_pages(spark, d), "event")


def _short_page(spark, d) -> DataFrame:
    """S8 where the source ends early: page 7 has 40 records, so nothing after it is read."""
    short = F.when(F.col("skip") == 700, F.slice("results", 1, 40)).otherwise(F.col("results"))
    found = S.paged_records(pages(spark, d, "event").withColumn("results", short), limit=1000)
    return found.select("seq", "skip", F.col("r.safetyreportid").alias("safetyreportid"))


def _ci(spark, d) -> Star:
    """The star of mapping C, whose names are compared without case."""
    return sales_star(spark, d, "C", LCASE)


def _dim_names_ci(spark, d) -> DataFrame:
    parts = [df.select(F.lit(dim).alias("dim"), "id", "dimName") for dim, df in _ci(spark, d).dims.items() if dim in NAME_DIMENSIONS]
    return functools.reduce(DataFrame.unionByName, parts)


def _fresh(spark, d, name: str) -> str:
    import uuid

    return f"{_scratch(spark, d, name)}/{uuid.uuid4().hex[:8]}"


def _upsert_metadata(spark, d):
    """The first run's metadata is stored in buckets of its key, and the second run is merged into it."""
    base = _fresh(spark, d, "metadata")
    create_table(source_metadata(spark, d, FIRST_RUN), base, ["source_key"], buckets=8)
    merge_table(spark, base, source_metadata(spark, d, SECOND_RUN, only_open=True))
    return read_buckets(spark, base).orderBy("source_key")


def _merge_products(spark, d):
    """U1 on the products: those of size 13 move to another labeler, those of size 14 get a second package."""
    base = _fresh(spark, d, "products")
    products = load_ndc(spark, d).current
    create_table(products, base, ["product_ndc"])
    moved = products.where(F.col("product_ndc").endswith("-013")).withColumn("labeler_name", F.concat(F.coalesce("labeler_name", F.lit("")), F.lit(" (moved)")))
    second = products.where(F.col("product_ndc").endswith("-014")).withColumn("product_ndc", F.concat("product_ndc", F.lit("-B")))
    merge_table(spark, base, moved.unionByName(second))
    return read_buckets(spark, base)


# --- sales helpers --------------------------------------------------------------
_LANDED_CSV: dict[str, str] = {}


def _landed_raw(spark, d):
    """Mapping A landed once as CSV text files, then scanned with the fixed text schema."""
    path = _scratch(spark, d, "import_raw_csv")

    def land() -> str:
        land_csv(raw_sales(spark, d, "A"), path)
        return path

    return scan_import_raw(spark, once(_LANDED_CSV, path, land))


def _dim_upsert(spark, d):
    """M8: city dimension first loaded from mapping B, then upserted with mapping A's cities."""
    existing = sales_star(spark, d, "B").dims["dimCity"]
    return upsert_names(existing, distinct_names(stage_sales(raw_sales(spark, d, "A")), "City"))


def _dim_time_upsert(spark, d):
    """M9: time dimension of the refunded sales, then upserted with the days of all sales."""
    staged = stage_sales(raw_sales(spark, d, "A"))
    existing = with_surrogate_keys(distinct_days(staged.where(F.col("Is_Refunded") == 1)), "timeDay")
    return upsert_days(existing, distinct_days(staged))


def _fact_reload(spark, d):
    """The fact written twice to the same table (overwrite) reads back as one load."""
    star = _star(spark, d)
    path = _scratch(spark, d, "reload")
    write_star(star, path)
    write_star(star, path)
    return fact_output(read_star(spark, path).fact)


def _lookup_rejects(spark, d):
    staged = stage_sales(raw_sales(spark, d, "M"))
    star = run_etl(raw_sales(spark, d, "M"))
    return _staged_out(lookup_rejects(staged, star))


def _sink_roundtrip(spark, d):
    path = _scratch(spark, d, "sink_ndc")
    P.write_table(load_ndc(spark, d).current, path)
    return spark.read.parquet(path)


def _publish(spark, d):
    base = _scratch(spark, d, "published_ndc")
    P.publish_version(ndc_records(spark, d).drop("seq"), base)
    P.publish_version(load_ndc(spark, d).current, base)
    return P.read_current(spark, base)


def _source_keys(spark, d):
    ndc, events = load_ndc(spark, d), load_events(spark, d)
    checks = [
        (ndc.records, "product_ndc", "ndc_records"), (ndc.current, "product_ndc", "source_ndc_products"),
        (events.records, "safetyreportid", "event_records"), (events.current, "safetyreportid", "source_drug_events"),
        (stored(spark, d, "source_metadata"), "source_key", "source_metadata"),
    ]
    return functools.reduce(DataFrame.unionByName, [C.primary_key(df, [key], label) for df, key, label in checks])


def _not_null(spark, d):
    star = _star(spark, d)
    tables = {
        "factDrug": (star.fact, ["id", "is_refunded", "cntDrug", "sumDrug", "avgDrug", "minDrug", "maxDrug"]),
        "dimTime": (star.dims["dimTime"], ["id", "timeDay", "timeWeekDay", "timeWeekNum"]),
    }
    for dim in ("dimCity", "dimConTh", "dimDrug", "dimDrugType", "dimMan"):
        tables[dim] = (star.dims[dim], ["id", "dimName"])
    tables["source_metadata"] = (source_metadata(spark, d), ["source_key", "source_name", "source_url", "records_loaded"])
    return C.not_null_counts(tables)


def _key_lookup(spark, d):
    star = _star(spark, d)
    return _staged_out(key_lookup(stage_sales(raw_sales(spark, d, "A")), star))


def _star_rows(spark, d):
    star = _star(spark, d)
    df = star_join(star, ALL_DIMS)
    return df.select(
        "id", "city", "condition", "drug", "drug_type", "manufacturer", "timeDay", "timeMonth", "timeYear",
        "is_refunded", F.col("cntDrug").cast("long").alias("cntDrug"), as_double(F.col("sumDrug")).alias("sumDrug"),
    )


def _stream_events(spark, d):
    """Streaming re-aim of the event load: drain the pages of one crawl in micro-batches, then read keep-last."""
    root = _fresh(spark, d, "stream")
    spark.read.schema(page_schema("event")).json(landed_page_set(spark, d, "event")).write.json(f"{root}/landing/run=1", compression="gzip")
    start_event_stream(spark, f"{root}/landing", f"{root}/log", f"{root}/_checkpoint", max_files_per_trigger=2).awaitTermination()
    return current_events(spark, f"{root}/log")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    # 2.1 scans and sources
    q["scan_import_raw"] = _landed_raw
    q["scan_star_projection"] = lambda s, d: scan_projection(
        _star(s, d).dims["dimTime"], ["id", "timeDay", "timeWeekDay", "timeWeekNum", "timeMonth", "timeYear"])
    q["scan_full_table"] = lambda s, d: _exported(s, d, "dimMan")
    for table in EXPORTED:
        q[f"export_{table}"] = (lambda table: lambda s, d: _exported(s, d, table))(table)
    for dim in NAME_DIMENSIONS:
        q[f"scan_{dim}"] = (lambda dim: lambda s, d: scan_projection(_star(s, d).dims[dim], ["id", "dimName"]))(dim)
    q["scan_factDrug"] = lambda s, d: scan_projection(fact_output(_star(s, d).fact), [
        "id", "dimCity_id", "dimConTh_id", "dimDrug_id", "dimDrugType_id", "dimMan_id", "dimTime_id", "is_refunded",
        "cntDrug", "sumDrug", "avgDrug", "minDrug", "maxDrug"])
    q["ndc_flatten"] = ndc_records
    q["ndc_flatten_strict"] = lambda s, d: S.flatten_ndc_strict(S.records(pages(s, d, "ndc")))
    q["event_flatten"] = event_records
    q["event_flatten_blank"] = lambda s, d: S.flatten_events_blank(S.records(pages(s, d, "event")))
    q["paged_limit"] = lambda s, d: S.paged_records(pages(s, d, "event"), limit=1000).select(
        "seq", "skip", F.col("r.safetyreportid").alias("safetyreportid"))
    q["paged_limit_short_page"] = _short_page
    q["event_pages_checked"] = lambda s, d: S.flatten_events(S.records(_broken_pages(s, d)[0]))
    q["event_page_rejects"] = lambda s, d: _broken_pages(s, d)[1].select("skip", "reason")
    q["source_total_available"] = lambda s, d: S.total_available(pages(s, d, "event"))
    q["event_date_range"] = lambda s, d: S.event_date_range(event_records(s, d))
    q["event_range_pruned"] = _event_store
    q["load_limit"] = lambda s, d: S.load_limit(ndc_records(s, d), limit=5000, cap=S.NDC_LOAD_CAP).select(
        "seq", "product_ndc")
    q["load_limit_events"] = lambda s, d: S.load_limit(event_records(s, d), limit=500, cap=S.EVENT_LOAD_CAP).select(
        "seq", "safetyreportid")
    # 2.2 staging
    m_typed = lambda s, d: raw_sales(s, d, "M").select("Transaction_ID", *typed_columns(raw_sales(s, d, "M")))
    q["stage_timestamp"] = lambda s, d: m_typed(s, d).select("Transaction_ID", "Sale_Timestamp")
    q["stage_trim"] = lambda s, d: m_typed(s, d).select(
        "Transaction_ID", "Manufacturer", "Drug_Name", "Drug_Type", "Condition_Treated", "City")
    q["stage_price"] = lambda s, d: m_typed(s, d).select("Transaction_ID", as_double(F.col("Price")).alias("Price"))
    q["stage_refunded"] = lambda s, d: m_typed(s, d).select("Transaction_ID", "Is_Refunded")
    q["stage_not_null"] = lambda s, d: m_typed(s, d).where(
        F.col("Drug_Name").isNotNull() & F.col("Manufacturer").isNotNull() & F.col("City").isNotNull()
        & F.col("Price").isNotNull()).select("Transaction_ID")
    q["stage_sales"] = lambda s, d: _staged_out(stage_sales(raw_sales(s, d, "M")))
    q["stage_rejects"] = lambda s, d: stage_rejects(raw_sales(s, d, "M"))
    q["import_raw_checked"] = lambda s, d: _broken_raw(s, d)[0]
    q["load_rejects"] = lambda s, d: load_rejects(*reversed(_broken_raw(s, d)))
    q["text_truncate"] = lambda s, d: read_table(s, d, "documents", ["doc_id", "text"]).select(
        "doc_id", S.truncate_text(F.col("text")).alias("text"))
    q["list_to_text"] = lambda s, d: ndc_records(s, d).select("seq", "route")
    q["first_of_list"] = lambda s, d: event_records(s, d).select("seq", "medicinalproduct", "manufacturer_name")
    # 2.3 dimensions
    for name, dim in (("dim_city", "dimCity"), ("dim_condition", "dimConTh"), ("dim_drug", "dimDrug"),
                      ("dim_drug_type", "dimDrugType"), ("dim_manufacturer", "dimMan"), ("dim_time", "dimTime")):
        q[name] = (lambda dim: lambda s, d: _star(s, d).dims[dim])(dim)
    q["dim_surrogate_key"] = lambda s, d: with_surrogate_keys(
        distinct_names(stage_sales(raw_sales(s, d, "M")), "Drug_Name"), "dimName")
    q["dim_upsert"] = _dim_upsert
    q["dim_time_upsert"] = _dim_time_upsert
    q["dim_time_upsert_changed"] = _dim_time_changed
    # 2.4 fact
    q["fact_key_lookup"] = _key_lookup
    q["fact_drug"] = lambda s, d: fact_output(run_etl(raw_sales(s, d, "B")).fact)
    q["fact_lookup_rejects"] = _lookup_rejects
    q["fact_lookup_rejects_unknown"] = lambda s, d: _staged_out(
        lookup_rejects(stage_sales(raw_sales(s, d, "A")), _orphaned(_star(s, d))))
    q["fact_drug_double"] = _fact_double
    q["fact_ids"] = lambda s, d: _star(s, d).fact.select(
        "id", "dimCity_id", "dimConTh_id", "dimDrug_id", "dimDrugType_id", "dimMan_id", "dimTime_id", "is_refunded")
    q["fact_reload"] = _fact_reload
    q["etl_end_to_end"] = lambda s, d: fact_output(run_etl(raw_sales(s, d, "A")).fact)
    q["etl_incremental_reload"] = lambda s, d: fact_output(
        run_etl(raw_sales(s, d, "A"), existing=sales_star(s, d, "B")).fact)
    # 2.5 star and filters
    q["star_join"] = _star_rows
    for name, f in FILTER_CASES.items():
        q[name] = _dash(D.kpi_summary, f)
    q["filter_combined"] = lambda s, d: D.monthly_sales(_star(s, d), Filters.from_params(COMBINED_PARAMS))
    # 2.6 dashboard
    q["kpi_summary"] = _dash(D.kpi_summary)
    q["kpi_summary_empty"] = _dash(D.kpi_summary, EMPTY_FILTER)
    q["monthly_sales"] = _dash(D.monthly_sales)
    q["ranked_by_transactions"] = lambda s, d: D.ranked(_star(s, d), "manufacturer", order_key="transactions", limit=10)
    q["top_drugs"] = _dash(D.top_drugs)
    q["top_manufacturers"] = _dash(D.top_manufacturers)
    q["top_cities"] = _dash(D.top_cities)
    q["top_conditions"] = _dash(D.top_conditions)
    q["top_drug_types"] = _dash(D.top_drug_types)
    q["drug_type_split"] = _dash(D.drug_type_split)
    q["refund_split"] = _dash(D.refund_split)
    q["refund_share"] = lambda s, d: D.refund_share(D.refund_split(_star(s, d)))
    q["recent_records"] = _dash(D.recent_records)
    q["top_labelers"] = lambda s, d: D.top_labelers(stored(s, d, "source_ndc_products"))
    q["top_labelers_ci"] = lambda s, d: D.top_labelers(stored(s, d, "source_ndc_products"), LCASE)
    q["top_reactions_ci"] = lambda s, d: D.top_reactions(stored(s, d, "source_drug_events"), LCASE)
    # K3: dimensions, fact, filters and rankings under a case-insensitive collation
    q["dim_names_ci"] = _dim_names_ci
    q["fact_drug_ci"] = lambda s, d: fact_output(_ci(s, d).fact)
    for name, f in CI_FILTER_CASES.items():
        q[name] = (lambda f: lambda s, d: D.kpi_summary(_ci(s, d), f))(f)
    q["top_drugs_ci"] = lambda s, d: D.top_drugs(_ci(s, d))
    q["top_reactions"] = lambda s, d: D.top_reactions(stored(s, d, "source_drug_events"))
    q["source_summary"] = lambda s, d: D.source_summary(
        stored(s, d, "source_metadata"), stored(s, d, "source_ndc_products"), stored(s, d, "source_drug_events"))
    for name, dim in (("filter_cities", "dimCity"), ("filter_conditions", "dimConTh"), ("filter_drugs", "dimDrug"),
                      ("filter_types", "dimDrugType"), ("filter_manufacturers", "dimMan")):
        q[name] = (lambda dim: lambda s, d: D.filter_values(_star(s, d), dim))(dim)
    q["filter_years"] = lambda s, d: D.filter_years(_star(s, d))
    # 2.7 views
    q["view_dashboard_summary"] = lambda s, d: _view(s, d, "v_dashboard_summary")
    q["view_sales_by_month"] = lambda s, d: _view(s, d, "v_sales_by_month").orderBy("year_number", "month_name")
    q["view_top_drugs"] = lambda s, d: _view(s, d, "v_top_drugs")
    q["view_top_manufacturers"] = lambda s, d: _view(s, d, "v_top_manufacturers")
    q["view_city_sales"] = lambda s, d: _view(s, d, "v_city_sales")
    q["view_open_source_summary"] = lambda s, d: _view(s, d, "v_open_source_summary")
    # 2.8 upserts and sinks
    q["upsert_metadata"] = _upsert_metadata
    q["merge_products"] = _merge_products
    q["keep_last_ndc"] = lambda s, d: load_ndc(s, d).current
    q["keep_last_events"] = lambda s, d: load_events(s, d).current
    q["stream_events_keep_last"] = _stream_events
    q["stream_events_snapshot"] = _stream_snapshot
    q["load_bookkeeping"] = lambda s, d: source_metadata(s, d)
    q["sink_roundtrip"] = _sink_roundtrip
    q["json_rows_keep_nulls"] = lambda s, d: P.json_rows(stored(s, d, "source_ndc_products"), keep_nulls=True)
    q["json_rows_drop_nulls"] = lambda s, d: P.json_rows(stored(s, d, "source_ndc_products"), keep_nulls=False)
    q["json_single"] = lambda s, d: P.json_single(D.top_labelers(stored(s, d, "source_ndc_products")))
    q["publish_version"] = _publish
    # 2.9 checks
    q["check_unique_dims"] = lambda s, d: C.unique_dims(_star(s, d))
    q["check_fact_fks"] = lambda s, d: C.fact_foreign_keys(_star(s, d))
    q["check_source_pks"] = _source_keys
    q["check_not_null"] = _not_null
    q["check_fact_grain"] = lambda s, d: C.fact_grain(_star(s, d))
    q["check_fact"] = lambda s, d: C.fact_violations(_repeated(_orphaned(_star(s, d))))
    q["check_unique_dims_planted"] = lambda s, d: C.unique_dims(_doubled(_star(s, d)))
    q["check_fact_fks_planted"] = lambda s, d: C.fact_foreign_keys(_orphaned(_star(s, d)))
    q["check_fact_grain_planted"] = lambda s, d: C.duplicates(_repeated(_star(s, d)).fact, ["id"], "factDrug.id")
    return q


#: Stored tables: the star's and the sources'.
EXPORTED = ["factDrug", *NAME_DIMENSIONS, "dimTime", "source_metadata", "source_ndc_products", "source_drug_events"]


def _exported(spark, d, name: str) -> DataFrame:
    """S3: the table that the catalog has under ``name``, written whole and read back."""
    star = _star(spark, d)
    star = replace(star, fact=fact_output(star.fact))
    register_star(spark, star, {n: stored(spark, d, n) for n in EXPORTED if n.startswith("source_")})
    out = _scratch(spark, d, "export")
    export_tables(spark, out, [name])
    return spark.read.parquet(f"{out}/{name}")


def _view(spark, d, name):
    metadata = stored(spark, d, "source_metadata") if name == "v_open_source_summary" else None
    return V.register_view(spark, name, _star(spark, d), metadata)


# --- faults planted in the stored star: each check has something to find ----------------------
def _doubled(star: Star) -> Star:
    """Every third name a second time under another id, and every fifth id under another name."""
    dims = {}
    for name, df in star.dims.items():
        again = df.where(F.col("id") % 3 == 0).withColumn("id", F.col("id") + 1_000_000)
        if name != "dimTime":
            again = again.unionByName(df.where(F.col("id") % 5 == 0).withColumn("dimName", F.concat("dimName", F.lit("*"))))
        dims[name] = df.unionByName(again.select(df.columns))
    return replace(star, dims=dims, measured={})


def _orphaned(star: Star) -> Star:
    """The star without every fourth drug and every hundredth day."""
    dims = star.dims | {"dimDrug": star.dims["dimDrug"].where("id % 4 <> 0"), "dimTime": star.dims["dimTime"].where("id % 100 <> 0")}
    return replace(star, dims=dims, measured={})


def _repeated(star: Star) -> Star:
    """Every thousandth fact row a second time, with no refund flag on every two thousandth."""
    again = star.fact.where(F.col("id") % 1000 == 0)
    blank = F.when(F.col("id") % 2000 != 0, F.col("is_refunded")).alias("is_refunded")
    return replace(star, fact=star.fact.unionByName(again.select(*[blank if c == "is_refunded" else c for c in again.columns])), measured={})


def _dim_time_changed(spark, d):
    """M9: stored days of the refunded sales have other weeks; those that the other sales have too are refreshed."""
    staged = stage_sales(raw_sales(spark, d, "A"))
    old = with_surrogate_keys(distinct_days(staged.where(F.col("Is_Refunded") == 1)), "timeDay")
    return upsert_days(old.withColumn("timeWeekNum", F.lit(99)), distinct_days(staged.where(F.col("Is_Refunded") == 0)))


def _event_store(spark, d):
    """S10 on the store by month: all reports, then one year of them again; the range reads its months alone."""
    path = _scratch(spark, d, "event_store")
    events = event_records(spark, d)
    S.write_event_store(events, path)
    S.write_event_store(events.where(F.col("receivedate").startswith("2024")), path)
    return S.read_event_range(spark, path)


def _stream_snapshot(spark, d):
    """The event stream in two runs with a compaction between: snapshot and later batches give the table."""
    root = _fresh(spark, d, "stream")
    # the first run sees the pages of the first half of the reports
    landed = spark.read.schema(page_schema("event")).json(landed_page_set(spark, d, "event"))
    middle = landed.agg(F.max("skip")).first()[0] // 2
    for half in (F.col("skip") <= middle, F.col("skip") > middle):
        landed.where(half).write.mode("append").json(f"{root}/landing/run=1", compression="gzip")
        start_event_stream(spark, f"{root}/landing", f"{root}/log", f"{root}/_checkpoint", max_files_per_trigger=100).awaitTermination()
        if latest_version(spark, f"{root}/snapshots") == 0:
            compact_events(spark, f"{root}/log", f"{root}/snapshots")
    return snapshot_and_tail(spark, f"{root}/log", f"{root}/snapshots")
