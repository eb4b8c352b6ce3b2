"""Export by catalog (S3), views one by one (V7), the event store by month (S10), snapshot and tail (U2), checks in one scan."""

import json
import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rxstar.operators import quality as Q
from rxstar.operators.fact import run_etl
from rxstar.plans import views as V
from rxstar.plans.catalog import export_tables, register_star
from rxstar.schemas import IMPORT_RAW
from rxstar.sources import openfda as S
from rxstar.streaming.incremental import compact_events, current_events, snapshot_and_tail, start_event_stream
from test_plans import plan


@pytest.fixture(scope="module")
def star(spark):
    rows = [(str(i), f"2024-0{i % 3 + 1}-05", f"M{i % 4}", f"D{i % 5}", f"{i}.50", "T", "0", "C", f"City {i % 7}") for i in range(60)]
    return run_etl(spark.createDataFrame(rows, IMPORT_RAW))


def test_export_writes_what_the_catalog_lists(spark, star, tmp_path):
    names = register_star(spark, star)
    out = str(tmp_path / "out")
    assert export_tables(spark, out, names) == names
    for name in names:
        got, want = spark.read.parquet(f"{out}/{name}"), spark.table(name)
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    spark.range(4).withColumnRenamed("id", "odd.name").createOrReplaceTempView("oddly_named")
    assert export_tables(spark, out, ["ODDLY_NAMED"]) and spark.read.parquet(f"{out}/ODDLY_NAMED").columns == ["odd.name"]
    spark.catalog.dropTempView("oddly_named")
    with pytest.raises(KeyError):
        export_tables(spark, out, ["no_such_table"])


def test_only_the_asked_view_is_registered(spark, star):
    for name in [*V.VIEW_NAMES, "v_open_source_summary"]:
        spark.catalog.dropTempView(name)
    assert V.register_view(spark, "v_top_drugs", star).count() == 5
    assert [n for n in [*V.VIEW_NAMES, "v_open_source_summary"] if spark.catalog.tableExists(n)] == ["v_top_drugs"]
    for name in ("v_nothing", "v_open_source_summary"):
        with pytest.raises(KeyError):
            V.register_view(spark, name, star)


def _events(spark, rows):
    return spark.createDataFrame(rows, "safetyreportid string, receivedate string, reaction string")


def test_event_ranges_read_their_months_alone(spark, tmp_path):
    path = str(tmp_path / "events")
    S.write_event_store(_events(spark, [("1", "20231231", "a"), ("2", "20240101", "b"), ("3", "20240315", "c"), ("4", None, "d")]), path)
    S.write_event_store(_events(spark, [("5", "20240301", "new")]), path)  # March again: only it is replaced
    got = S.read_event_range(spark, path, "20240101", "20240331")
    assert {tuple(r) for r in got.collect()} == {("2", "20240101", "b"), ("5", "20240301", "new")}
    assert "received_month" in plan(got).split("PartitionFilters")[1].splitlines()[0]
    assert got.columns == ["safetyreportid", "receivedate", "reaction"]
    whole = spark.read.parquet(path)
    assert whole.count() == 4 and whole.where("safetyreportid = '4'").count() == 1


def test_a_month_of_a_third_of_all_reports_is_several_files(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("safetyreportid"), F.lit("20240505").alias("receivedate"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.write_event_store(rows, str(tmp_path / "e"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spark.read.parquet(str(tmp_path / "e")).inputFiles()) > 1


def _land(folder, name, ids, tag, age):
    reports = [{"safetyreportid": str(i), "serious": "1", "patient": {"patientsex": tag}} for i in ids]
    (folder / name).write_text(json.dumps({"skip": 0, "meta": {"results": {"total": 9}}, "results": reports}))
    then = time.time() - age
    os.utime(folder / name, (then, then))


def test_snapshot_and_later_batches_give_the_table(spark, tmp_path):
    """Late pages re-issue reports of the snapshot; a second compaction starts from the first."""
    landing, log, base = tmp_path / "landing", str(tmp_path / "log"), str(tmp_path / "snap")
    landing.mkdir()

    def run():
        start_event_stream(spark, str(landing), log, str(tmp_path / "ck")).awaitTermination()

    def table(df):
        return {r["safetyreportid"]: r["patientsex"] for r in df.collect()}

    _land(landing, "a.json", [1, 2, 3], "first", 300)
    _land(landing, "b.json", [2], "second", 200)
    run()
    assert table(snapshot_and_tail(spark, log, base)) == {"1": "first", "2": "second", "3": "first"}  # no snapshot yet
    compact_events(spark, log, base)
    assert table(snapshot_and_tail(spark, log, base)) == table(current_events(spark, log))
    _land(landing, "late.json", [3, 4], "late", 100)
    run()
    df = snapshot_and_tail(spark, log, base)
    assert table(df) == table(current_events(spark, log)) == {"1": "first", "2": "second", "3": "late", "4": "late"}
    assert "PartitionFilters: [isnotnull(batch_id" in plan(df)  # the log's earlier folders are left out
    compact_events(spark, log, base)
    _land(landing, "z.json", [1], "last", 10)
    run()
    assert table(snapshot_and_tail(spark, log, base)) == {"1": "last", "2": "second", "3": "late", "4": "late"}


def test_checks_scan_the_fact_once(star):
    for df in (Q.fact_foreign_keys(star), Q.fact_violations(star)):
        assert df.count() == 0
        scans = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in x and "dimCity_id#" in x]
        assert len(scans) == 1


def test_planted_violations_come_out(spark, star):
    f = star.fact
    bad = f.where("id = 1").unionByName(f.where("id = 2").withColumn("dimCity_id", F.lit(99)).withColumn("sumDrug", F.lit(None).cast("decimal(20,2)")))
    broken = replace(star, fact=f.unionByName(bad), measured={})
    got = {(r["constraint"], r["n"]) for r in Q.fact_violations(broken).collect()}
    assert got == {("FOREIGN KEY dimCity_id", 1), ("UNIQUE grain", 2), ("PRIMARY KEY id", 2), ("NOT NULL sumDrug", 1)}
    assert [tuple(r) for r in Q.fact_foreign_keys(broken).collect()] == [("dimCity_id", 99, 1)]
    dims = star.dims | {"dimCity": star.dims["dimCity"].unionByName(spark.createDataFrame([(1, "City 6")], "id int, dimName string"))}
    found = {tuple(r) for r in Q.unique_dims(replace(star, dims=dims)).collect()}
    assert found == {("dimCity", "City 6", 2), ("dimCity.id", "1", 2)}
    assert "Exchange" in plan(Q.unique_dims(star)) and Q.unique_dims(star).count() == 0


def test_pages_of_one_crawl_are_ordered_by_their_offsets(spark, tmp_path):
    """Within a run the arrival of a page does not matter; a later run wins."""

    def land(run, skip, ids, tag, age):
        folder = tmp_path / "landing" / f"run={run}"
        folder.mkdir(parents=True, exist_ok=True)
        _land(folder, f"p{skip}.json", ids, tag, age)
        page = json.loads((folder / f"p{skip}.json").read_text()) | {"skip": skip}
        (folder / f"p{skip}.json").write_text(json.dumps(page))
        then = time.time() - age
        os.utime(folder / f"p{skip}.json", (then, then))

    land(1, 100, [1, 2], "second page", 300)  # arrives first
    land(1, 0, [1, 3], "first page", 200)
    land(2, 0, [3], "next crawl", 100)
    start_event_stream(spark, str(tmp_path / "landing"), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    got = {r["safetyreportid"]: r["patientsex"] for r in current_events(spark, str(tmp_path / "log")).collect()}
    assert got == {"1": "second page", "2": "second page", "3": "next crawl"}
