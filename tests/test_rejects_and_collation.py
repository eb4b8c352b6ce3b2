"""Broken input lines (S1, S4-S7, T7), one-scan loads (U3, S9) and names compared without case (K3)."""

import json

import pytest
from pyspark.sql import functions as F

from rxstar import jobs
from rxstar.functions.collation import BINARY, LCASE, fold
from rxstar.operators.fact import key_lookup, lookup_rejects, run_etl
from rxstar.operators.load import load_source
from rxstar.operators.staging import stage_sales
from rxstar.plans import dashboard as D
from rxstar.plans.filters import Filters
from rxstar.schemas import IMPORT_RAW
from rxstar.sources import openfda as S
from rxstar.sources.raw import scan_import_raw_checked

HEADER = ",".join(IMPORT_RAW.names)
GOOD = '1,2024-01-05,Acme," Aspirin, plain ",10.50,OTC,yes,Pain,Oslo'


def test_broken_csv_lines_come_out_with_reasons(spark, tmp_path):
    lines = [GOOD, "2,2024-01-05,Acme", GOOD + ",x", '3,2024-01-05,"a,b",D,1,T,0,C', '4,2024-01-05,\\N,"",1,T,0,C,X']
    (tmp_path / "raw.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    rows, rejects = scan_import_raw_checked(spark, str(tmp_path / "raw.csv"))
    assert [(r["Transaction_ID"], r["reason"], r["line"]) for r in rejects.orderBy("line").collect()] == sorted(
        [("1", "too many fields", lines[2]), ("2", "too few fields", lines[1]), ("3", "too few fields", lines[3])], key=lambda x: x[2])
    assert {(r["Transaction_ID"], r["Manufacturer"], r["Drug_Name"]) for r in rows.collect()} == {("1", "Acme", " Aspirin, plain "), ("4", None, "")}
    assert rows.count() + rejects.count() == len(lines) and rows.columns == IMPORT_RAW.names
    assert rejects.select("reason").distinct().count() == 2  # also where only one column is asked for


def test_etl_job_stores_what_it_drops(spark, tmp_path):
    lines = [GOOD, "2,2024-01-05,Acme", GOOD.replace("10.50", "n/a").replace("1,", "5,", 1)]
    (tmp_path / "raw.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    out = jobs.main(["etl", "--raw", str(tmp_path / "raw.csv"), "--format", "csv", "--out", str(tmp_path / "star"),
                     "--rejects", str(tmp_path / "rejects"), "--collation", LCASE], spark=spark)
    assert out["fact_rows"] == 1
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert got == {("2", "scan", "too few fields"), ("5", "staging", "bad price")}


def _page(skip, ids):
    reports = [{"safetyreportid": str(i), "serious": "1", "patient": {"patientsex": f"p{skip}"}} for i in ids]
    return json.dumps({"skip": skip, "meta": {"results": {"total": 9}}, "results": reports})


def test_broken_pages_come_out_with_reasons(spark, tmp_path):
    lines = [_page(0, [1, 2]), _page(2, [3])[:40], json.dumps({"skip": 3, "results": "none"}), "oops", "[1]", _page(4, [])]
    (tmp_path / "p.json").write_text("\n".join(lines) + "\n\n")
    pages, rejects = S.read_pages_checked(spark, str(tmp_path), "event")
    got = {(r["skip"], r["reason"], r["line"]) for r in rejects.collect()}
    assert got == {(2, "not JSON", lines[1]), (3, "not a page", lines[2]), (None, "not JSON", "oops"), (None, "not a page", "[1]")}
    assert pages.count() == 2 and S.flatten_events(S.records(pages)).count() == 2
    assert pages.count() + rejects.count() == len(lines)


def test_a_load_reads_its_pages_once(spark, tmp_path):
    """Rows, keep-last and the counts come from one scan; the last page is empty and still tells the total."""
    (tmp_path / "p.json").write_text("\n".join([_page(0, [1, 2]), _page(100, [2, 3]), _page(200, []).replace("9", "11")]))
    loaded = load_source(S.read_pages(spark, str(tmp_path), "event"), S.flatten_events, "openfda_event", ["safetyreportid"], "t1")
    meta = loaded.metadata.collect()[0]
    assert (meta["records_loaded"], meta["total_available"], meta["fetched_at"]) == (4, 11, "t1")
    assert {(r["safetyreportid"], r["patientsex"]) for r in loaded.current.collect()} == {("1", "p0"), ("2", "p100"), ("3", "p100")}
    for df in (loaded.records, loaded.current, loaded.metadata):
        assert "json" not in df._jdf.queryExecution().executedPlan().toString().lower().replace("to_json", "")
    (tmp_path / "p.json").write_text("")
    empty = load_source(S.read_pages(spark, str(tmp_path), "event"), S.flatten_events, "openfda_event", ["safetyreportid"], "t1")
    assert empty.current.count() == 0 and empty.metadata.collect()[0]["records_loaded"] == 0


# --- K3 ----------------------------------------------------------------------------------------


def _raw(spark, rows):
    return spark.createDataFrame([(str(i), d, "Acme", drug, price, "OTC", "0", "Pain", city) for i, (d, drug, price, city) in enumerate(rows)], IMPORT_RAW)


SALES = [("2024-01-05", "Aspirin", "1.00", "OSLO"), ("2024-01-05", "ASPIRIN", "2.00", "Oslo"), ("2024-01-05", "aspirin", "4.00", "oslo"),
         ("2024-02-01", "Ibuprofen", "8.00", "Ærø"), ("2024-02-01", "ibuprofen", "16.00", "ærØ")]


def test_names_that_differ_in_case_share_an_id(spark):
    star = run_etl(_raw(spark, SALES), collation=LCASE)
    assert sorted(r["dimName"] for r in star.dims["dimCity"].collect()) == ["OSLO", "Ærø"]  # the smallest spelling by bytes
    assert sorted(r["dimName"] for r in star.dims["dimDrug"].collect()) == ["ASPIRIN", "Ibuprofen"]
    facts = sorted((r["cntDrug"], float(r["sumDrug"]), float(r["minDrug"]), float(r["maxDrug"]), r["avgDrug"]) for r in star.fact.collect())
    assert facts == [(2, 24.0, 8.0, 16.0, 12.0), (3, 7.0, 1.0, 4.0, 7.0 / 3)]
    for city in ("oslo", "Oslo", "OSLO"):
        assert D.kpi_summary(star, Filters(city=city)).first()["transactions"] == 3
    assert D.kpi_summary(star, Filters(drug="IBUPROFEN", city="ÆRØ", year=2024)).first()["total_sales"] == 24.0
    assert [tuple(r)[:3] for r in D.top_drugs(star).collect()] == [("Ibuprofen", 24.0, 2), ("ASPIRIN", 7.0, 3)]
    staged = stage_sales(_raw(spark, SALES))
    assert key_lookup(staged, star).count() == 5 and lookup_rejects(staged, star).count() == 0
    binary = run_etl(_raw(spark, SALES), collation=BINARY)
    assert binary.dims["dimCity"].count() == 5 and D.kpi_summary(binary, Filters(city="oslo")).first()["transactions"] == 1


def test_a_reload_keeps_the_first_spelling_and_its_id(spark):
    first = run_etl(_raw(spark, SALES[2:3]), collation=LCASE)
    again = run_etl(_raw(spark, SALES), existing=first, collation=LCASE)
    assert {(r["id"], r["dimName"]) for r in again.dims["dimCity"].collect()} == {(1, "oslo"), (2, "Ærø")}
    assert lookup_rejects(stage_sales(_raw(spark, SALES + [("2024-02-01", "Other", "1", "Oslo")])), again).collect()[0]["reason"] == "no dimDrug"


def test_double_measures_under_a_collation(spark):
    fact = run_etl(_raw(spark, SALES), measure="double", collation=LCASE).fact.orderBy("cntDrug").collect()
    assert [(r["cntDrug"], r["sumDrug"], r["avgDrug"]) for r in fact] == [(2, 24.0, 12.0), (3, 7.0, 7.0 / 3)]


def test_fold_agrees_with_the_collation(spark):
    words = ["Straße", "STRASSE", "ÆRØ", "ærø", "", "a", "A", "é", "É", "ÀB", "àb"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    same = F.collate("a", LCASE) == F.collate("b", LCASE)
    assert pairs.where(same != (fold(F.col("a"), LCASE) == fold(F.col("b"), LCASE))).count() == 0
    with pytest.raises(ValueError):
        fold(F.col("a"), "other")
