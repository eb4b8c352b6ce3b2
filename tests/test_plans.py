"""Plan checks: pushdown, pruning, joins only where needed, top-k, broadcast bounds."""

import contextlib
import io

import pytest

from rxstar.plans import dashboard as D
from rxstar.plans.filters import Filters
from rxstar.plans.warehouse import sales_star


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def star(spark, sf_dir):
    return sales_star(spark, sf_dir, "A")


def test_top_k_is_take_ordered(star):
    assert "TakeOrderedAndProject" in plan(D.top_drugs(star))


def test_unused_dimensions_not_joined(star):
    df = D.top_drugs(star)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Join ") == 1  # fact and the drug dimension only
    assert "dimName" in optimized and "timeDay" not in optimized


def test_dimension_filter_pushed_to_scan_and_join_inner(star):
    df = D.kpi_summary(star, Filters(city="NATION_3"))
    p = plan(df)
    assert "EqualTo(dimName,NATION_3)" in p
    assert "Join type: Inner" in p  # the filtered LEFT JOIN became INNER (dimTime stays outer)


def test_name_filter_reaches_the_fact_scan_as_an_id(star):
    optimized = D.kpi_summary(star, Filters(city="NATION_3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(dimCity_id" in optimized and "scalar-subquery" in optimized
    unknown = D.kpi_summary(star, Filters(city="no such city")).first()
    assert unknown["fact_groups"] == 0


def test_year_filter_prunes_fact_partitions(star):
    df = D.monthly_sales(star, Filters(year=1997))
    p = plan(df)
    assert "PartitionFilters: [isnotnull(fact_year" in p and "= 1997)]" in p


def test_dimensions_broadcast_within_bound(star):
    assert all(n is not None and n < 1_000_000 for n in star.dim_rows.values())
    assert "BroadcastHashJoin" in plan(D.top_drugs(star))


def test_scan_reads_only_needed_columns(star):
    p = plan(D.top_drugs(star))
    schemas = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert "ReadSchema: struct<dimDrug_id:int,cntDrug:bigint,sumDrug:decimal(20,2)>" in schemas


def test_api_routes(star, spark, sf_dir):
    from rxstar import registry
    from rxstar.plans.api import Sources, answer

    top = answer("/api/top-drugs", {"year": ["1997"], "city": [" "]}, star).collect()
    assert len(top) == 10 and top[0]["total_sales"] >= top[-1]["total_sales"]
    lists = answer("/api/filters", {}, star)
    assert set(lists) == {"cities", "conditions", "drugs", "types", "manufacturers", "years"}
    sources = Sources(*(registry.stored(spark, sf_dir, n) for n in ("source_metadata", "source_ndc_products",
                                                                     "source_drug_events")))
    assert answer("/api/source-summary", {}, star, sources).count() == 3
    with pytest.raises(ValueError):
        answer("/api/summary", {"refunded": ["maybe"]}, star)
    with pytest.raises(KeyError):
        answer("/api/nothing", {}, star)


def test_dashboard_sql_through_catalog(star, spark):
    from rxstar.plans.catalog import register_star

    register_star(spark, star)
    sql = """
        SELECT dr.dimName AS label,
               CAST(COALESCE(SUM(f.sumDrug), 0) AS DOUBLE) AS total_sales,
               COALESCE(SUM(f.cntDrug), 0) AS transactions
        FROM factDrug f
        LEFT JOIN dimDrug dr ON dr.id = f.dimDrug_id
        LEFT JOIN dimTime tt ON tt.id = f.dimTime_id
        WHERE tt.timeYear = 1997
        GROUP BY dr.dimName
        ORDER BY total_sales DESC, label
        LIMIT 10
    """
    got = [(r["label"], r["total_sales"], r["transactions"]) for r in spark.sql(sql).collect()]
    want = [(r["label"], r["total_sales"], r["transactions"])
            for r in D.top_drugs(star, Filters(year=1997)).collect()]
    assert got == want and len(got) == 10
    assert "TakeOrderedAndProject" in plan(spark.sql(sql))


def test_distinct_counts_take_no_row_expansion(star):
    from rxstar.plans.views import dashboard_summary

    for df in (D.kpi_summary(star, Filters(year=1997)), dashboard_summary(star)):
        assert "Expand" not in plan(df) and "bitmap_construct_agg" in plan(df)


def test_kpi_counts_ids_that_the_dimension_has(star, spark):
    """C2 fails: a fact key without a dimension row does not count, in the fact itself it does."""
    from dataclasses import replace

    from rxstar.plans.views import dashboard_summary

    whole = D.kpi_summary(star).first()
    fewer = star.dims["dimDrug"].where("id > 3")
    less = replace(star, dims=star.dims | {"dimDrug": fewer}, measured={})
    row = D.kpi_summary(less).first()
    assert row["drug_count"] == whole["drug_count"] - 3 and row["manufacturer_count"] == whole["manufacturer_count"]
    assert row["transactions"] == whole["transactions"]
    assert dashboard_summary(less).first()["drug_count"] == whole["drug_count"]


def test_distinct_counts_beyond_the_bitmaps(star, monkeypatch):
    from rxstar.plans import views

    wanted, summary = D.kpi_summary(star).first(), views.dashboard_summary(star).first()
    for module in (D, views):
        monkeypatch.setattr(module, "MAX_BITMAPS", 0)
    assert D.kpi_summary(star).first() == wanted and views.dashboard_summary(star).first() == summary


def test_bitmaps_over_many_runs_of_ids(spark):
    from pyspark.sql import functions as F

    from rxstar.functions.distinct import bitmap_parts, bitmaps_needed, bits

    ids = spark.range(200_000).select(F.when(F.col("id") % 5 > 0, F.col("id") * 2 - 7).cast("int").alias("x"))
    parts = [p.alias(f"p{i}") for i, p in enumerate(bitmap_parts(F.col("x"), 399_990))]
    assert len(parts) == bitmaps_needed(399_990) == 13
    got = ids.agg(*parts).select(bits([F.col(f"p{i}") for i in range(13)])).first()[0]
    assert got == ids.where("x between 1 and 399990").distinct().count()


def test_recent_records_read_the_newest_years_alone(star):
    df = D.recent_records(star)
    newest = max(y for y in star.year_rows() if y is not None)
    assert f"(fact_year#" in plan(df) and f">= {newest})" in plan(df)  # a partition filter
    whole = D.filtered(star, None, {"dimTime"}).select("id", "timeDay").collect()
    want = sorted(whole, key=lambda r: (r["timeDay"], r["id"]), reverse=True)[:100]
    assert [r["id"] for r in df.collect()] == [r["id"] for r in want]


def test_recent_records_go_back_as_far_as_needed(star):
    """A filter on few rows, more rows than a year has, all rows, none."""
    whole = D.star_join(star, {"dimTime", "dimDrug"}).select("id", "timeDay", "drug").collect()
    order = sorted(whole, key=lambda r: (r["timeDay"], r["id"]), reverse=True)
    drug = order[-1]["drug"]
    for limit in (0, 1, 40, len(order) - 1, len(order) + 5):
        assert [r["id"] for r in D.recent_records(star, limit=limit).collect()] == [r["id"] for r in order[:limit]]
        want = [r["id"] for r in order if r["drug"] == drug][:limit]
        assert [r["id"] for r in D.recent_records(star, Filters(drug=drug), limit=limit).collect()] == want
    assert D.recent_records(star, Filters(drug="none")).count() == 0


def test_rows_without_a_day_come_last(star, spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    few = star.fact.orderBy("id").limit(5).withColumn("dimTime_id", F.when(F.col("id") <= 3, F.col("dimTime_id")))
    few = few.withColumn("fact_year", F.when(F.col("id") <= 3, F.col("fact_year")))
    rows = D.recent_records(replace(star, fact=few, measured={}), limit=4).collect()
    assert [r["sale_date"] is None for r in rows] == [False, False, False, True] and rows[3]["id"] == 5
