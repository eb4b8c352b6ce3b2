"""Operators on tiny literal frames: staging, dimensions, fact, upserts, sinks, checks."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rxstar.operators import quality as Q
from rxstar.operators import sinks as P
from rxstar.operators.dimensions import distinct_days, upsert_days, upsert_names, with_surrogate_keys
from rxstar.operators.fact import run_etl
from rxstar.operators.staging import stage_rejects, stage_sales
from rxstar.operators.upsert import bookkeeping, keep_last, metadata_seed, upsert_by_key
from rxstar.plans import dashboard as D
from rxstar.plans.filters import Filters
from rxstar.schemas import IMPORT_RAW, SOURCE_METADATA

RAW = [
    ("1", "2024-01-05 10:00:00", "Acme", " Aspirin ", "10,50", "OTC", "yes", "Pain", "Oslo"),
    ("1", "2024-01-05 10:00:00", "Acme", " Aspirin ", "10,50", "OTC", "yes", "Pain", "Oslo"),  # duplicate kept
    ("2", "2024-1-6 8:5:0", "Acme", "Aspirin", "20.00", "OTC", "0", "Pain", "Oslo"),
    ("3", "2024-02-01", "Beta", "Ibuprofen", "5", "RX", "t", None, "Bergen"),  # no condition: lost in lookup
    ("4", "garbage", "Beta", "Ibuprofen", "7", "RX", "no", "Fever", "Bergen"),  # bad timestamp
    ("5", "2024-02-01", "Beta", "Ibuprofen", "n/a", "RX", "no", "Fever", "Bergen"),  # bad price
    ("6", "2024-02-01", None, "Ibuprofen", "3", "RX", "no", "Fever", "Bergen"),  # missing manufacturer
    ("7", "2024-02-02", "", "Ibuprofen", "4", "RX", "no", "Fever", "Bergen"),  # empty manufacturer is a member
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, IMPORT_RAW)


def test_stage_sales_keeps_duplicates_and_filters(raw):
    staged = stage_sales(raw).collect()
    assert len(staged) == 6
    assert sum(1 for r in staged if r["Drug_Name"] == "Aspirin" and r["Price"] == Decimal("10.50")) == 2


def test_stage_rejects_reasons(raw):
    got = {r["Transaction_ID"]: r["reason"] for r in stage_rejects(raw).collect()}
    assert got == {"4": "bad timestamp", "5": "bad price", "6": "missing manufacturer"}


def test_etl_invariants(raw):
    star = run_etl(raw)
    staged = stage_sales(raw)
    fact = star.fact.collect()
    # 6 staged rows; the null-condition row and the bad-timestamp row have no lookup match.
    assert sum(r["cntDrug"] for r in fact) == 4
    assert sum(r["sumDrug"] for r in fact) == Decimal("45.00")
    assert sorted(r["id"] for r in fact) == list(range(1, len(fact) + 1))
    names = {r["dimName"]: r["id"] for r in star.dims["dimMan"].collect()}
    assert names == {"": 1, "Acme": 2, "Beta": 3}
    days = star.dims["dimTime"].orderBy("id").collect()
    assert [(str(r["timeDay"]), r["timeWeekDay"], r["timeMonth"]) for r in days] == [
        ("2024-01-05", 6, "2024-01"), ("2024-01-06", 7, "2024-01"), ("2024-02-01", 5, "2024-02"),
        ("2024-02-02", 6, "2024-02")]
    assert staged.count() == 6
    for check in (Q.unique_dims(star), Q.fact_foreign_keys(star), Q.fact_grain(star)):
        assert check.count() == 0


def test_loading_twice_keeps_dimension_ids(raw, spark):
    first = run_etl(raw)
    more = spark.createDataFrame(
        [("9", "2024-03-01 00:00:00", "Gamma", "Aspirin", "1", "OTC", "0", "Pain", "Aalborg")], IMPORT_RAW)
    second = run_etl(raw.unionByName(more), existing=first)
    cities = {r["dimName"]: r["id"] for r in second.dims["dimCity"].collect()}
    assert cities == {"Bergen": 1, "Oslo": 2, "Aalborg": 3}  # existing ids kept, new name appended
    assert {r["dimName"]: r["id"] for r in second.dims["dimMan"].collect()}["Gamma"] == 4


def test_upsert_names_and_days(spark):
    existing = with_surrogate_keys(spark.createDataFrame([("b",), ("a",)], "dimName string"), "dimName")
    new = spark.createDataFrame([("c",), ("a",), ("0",)], "dimName string")
    got = {r["dimName"]: r["id"] for r in upsert_names(existing, new).collect()}
    assert got == {"a": 1, "b": 2, "0": 3, "c": 4}
    ts = spark.createDataFrame([("2024-01-02 00:00:00",), ("2024-01-01 00:00:00",)], "s string").select(
        F.to_timestamp("s").alias("Sale_Timestamp"))
    old = with_surrogate_keys(distinct_days(ts.limit(1).where("Sale_Timestamp < '2024-01-02'")), "timeDay")
    merged = upsert_days(old, distinct_days(ts)).orderBy("id").collect()
    assert [(r["id"], str(r["timeDay"])) for r in merged] == [(1, "2024-01-01"), (2, "2024-01-02")]


def test_kpi_on_empty_selection(raw):
    star = run_etl(raw)
    row = D.kpi_summary(star, Filters(city="nowhere")).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["fact_groups"], r["transactions"], r["total_sales"], r["avg_price"], r["refund_rate"]) == (0, 0, 0.0, 0.0, 0.0)
    assert r["date_from"] is None and r["date_to"] is None


def test_filters_from_params():
    f = Filters.from_params({"city": [" Oslo ", "x"], "drug": ["  "], "year": ["2024"], "refunded": ["1"]})
    assert f.active() == {"city": "Oslo", "year": 2024, "refunded": 1}
    assert f.dimensions() == {"dimCity", "dimTime"}
    with pytest.raises(ValueError):
        Filters.from_params({"year": ["twenty"]})  # K13


def test_keep_last_and_upsert(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("j", 1, "only")],
                               "key string, seq int, v string")
    got = {r["key"]: r["v"] for r in keep_last(df, ["key"], ["seq"]).collect()}
    assert got == {"k": "new", "j": "only"}
    old = metadata_seed(spark, [("a", "A", "u", 1, 10, "t1"), ("b", "B", "u", 2, None, "t1")])
    new = metadata_seed(spark, [("a", "A2", "u2", 5, None, "t2"), ("c", "C", "u", 3, 3, "t2")])
    got = {r["source_key"]: tuple(r) for r in upsert_by_key(old, new, ["source_key"]).collect()}
    assert got["a"] == ("a", "A2", "u2", 5, None, "t2")  # every column from the new side, NULL included
    assert got["b"] == ("b", "B", "u", 2, None, "t1") and got["c"][1] == "C"
    assert upsert_by_key(old, new, ["source_key"]).schema.names == SOURCE_METADATA.names


def test_bookkeeping_counts_before_dedupe(spark):
    loaded = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    total = spark.createDataFrame([(99,)], "total_available long")
    r = bookkeeping("openfda_ndc", loaded, total, "2026-01-01T00:00:00+00:00").collect()[0]
    assert (r["records_loaded"], r["total_available"], r["fetched_at"]) == (3, 99, "2026-01-01T00:00:00+00:00")


def test_json_sinks(spark):
    df = spark.createDataFrame([("a", None, 1)], "s string, n string, i int")
    assert P.json_rows(df, True).collect()[0][0] == '{"s":"a","n":null,"i":1}'
    assert P.json_rows(df, False).collect()[0][0] == '{"s":"a","i":1}'
    assert P.json_single(df.where("false")).collect()[0][0] == "{}"
    assert P.json_single(df).collect()[0][0] == '{"s":"a","n":null,"i":1}'


def test_publish_version_reads_newest(spark, tmp_path):
    base = str(tmp_path / "pub")
    P.publish_version(spark.createDataFrame([(1,)], "v int"), base)
    P.publish_version(spark.createDataFrame([(2,)], "v int"), base)
    assert [r[0] for r in P.read_current(spark, base).collect()] == [2]


def test_not_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    got = {(r["table_name"], r["column_name"]): r["nulls"] for r in Q.not_null_counts({"t": (df, ["a", "b"])}).collect()}
    assert got == {("t", "a"): 1, ("t", "b"): 2}


def test_streaming_event_load(spark, tmp_path):
    import json

    from rxstar.operators.sinks import read_current
    from rxstar.streaming.incremental import compact_events, current_events, start_event_stream

    landing = tmp_path / "landing"
    landing.mkdir()

    def page(skip, ids, tag):
        return {"skip": skip, "meta": {"results": {"total": 4}}, "results": [
            {"safetyreportid": str(i), "receivedate": "20250101", "serious": "1",
             "patient": {"patientsex": tag, "drug": None, "reaction": None}} for i in ids]}

    (landing / "p0.json").write_text(json.dumps(page(0, [1, 2], "old")))
    (landing / "p1.json").write_text(json.dumps(page(2, [2, 3], "new")))  # report 2 is re-issued
    import os
    import time

    now = time.time()  # the stream takes files in landing (modification time) order
    os.utime(landing / "p0.json", (now - 60, now - 60))
    os.utime(landing / "p1.json", (now - 30, now - 30))
    q = start_event_stream(spark, str(landing), str(tmp_path / "log"), str(tmp_path / "ck"), max_files_per_trigger=1)
    q.awaitTermination()
    got = {r["safetyreportid"]: r["patientsex"] for r in current_events(spark, str(tmp_path / "log")).collect()}
    assert got == {"1": "old", "2": "new", "3": "new"}
    compact_events(spark, str(tmp_path / "log"), str(tmp_path / "snap"))
    assert read_current(spark, str(tmp_path / "snap")).count() == 3
    from rxstar.streaming.incremental import batches_written

    assert sorted(r["records"] for r in batches_written(spark, str(tmp_path / "log")).collect()) == [2, 2]


def test_declared_schemas(raw):
    from rxstar.schemas import FACT_COLUMNS, NAME_DIM, TEMP_STD, TIME_DIM

    staged = stage_sales(raw)
    assert [(f.name, f.dataType) for f in staged.schema] == [(f.name, f.dataType) for f in TEMP_STD]
    star = run_etl(raw)
    assert [(f.name, f.dataType) for f in star.dims["dimCity"].schema] == [(f.name, f.dataType) for f in NAME_DIM]
    assert [(f.name, f.dataType) for f in star.dims["dimTime"].schema] == [(f.name, f.dataType) for f in TIME_DIM]
    assert sorted(star.fact.columns) == sorted(FACT_COLUMNS + ["fact_year"])


def test_scale_conf_sizes_partitions():
    from rxstar.session import scale_conf

    conf = scale_conf(100 * 2**40, total_cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409601 and conf["spark.sql.adaptive.enabled"] == "true"
    assert int(scale_conf(10, total_cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_invariants_on_messy_fixture(spark, sf_dir):
    """SURVEY §5.3 on mapping M: every staged row is either counted in the fact or a lookup reject."""
    from rxstar.operators.fact import lookup_rejects
    from rxstar.sources.fixtures import landed_raw_sales

    raw = landed_raw_sales(spark, sf_dir, "M")
    staged = stage_sales(raw)
    star = run_etl(raw)
    rejects = lookup_rejects(staged, star)
    n_staged, n_rejects = staged.count(), rejects.count()
    fact = star.fact.agg(F.sum("cntDrug").alias("n"), F.sum("sumDrug").alias("s")).collect()[0]
    assert fact["n"] == n_staged - n_rejects and n_rejects > 0
    staged_sum = staged.agg(F.sum("Price")).collect()[0][0]
    rejected_sum = rejects.agg(F.sum("Price")).collect()[0][0]
    assert fact["s"] == staged_sum - rejected_sum  # exact: DECIMAL throughout
    for check in (Q.unique_dims(star), Q.fact_foreign_keys(star), Q.fact_grain(star)):
        assert check.count() == 0


def test_batch_jobs(spark, sf_dir, tmp_path):
    from rxstar import jobs
    from rxstar.sources.fixtures import landed_raw_sales
    from rxstar.sources.landing import landed_pages

    raw_path = str(tmp_path / "import_raw")
    landed_raw_sales(spark, sf_dir, "A").write.parquet(raw_path)
    out = jobs.main(["etl", "--raw", raw_path, "--out", str(tmp_path / "star")], spark=spark)
    assert out["fact_rows"] > 0 and out["dimCity"] == 25
    again = jobs.main(["etl", "--raw", raw_path, "--out", str(tmp_path / "star2"), "--existing", str(tmp_path / "star")],
                      spark=spark)
    assert again == out  # same input into the same dimensions: nothing new
    pages = landed_pages(spark, sf_dir)
    res = jobs.main(["openfda", "--ndc", pages["ndc"], "--events", pages["event"], "--out", str(tmp_path / "src"),
                     "--fetched-at", "2026-06-01T09:00:00+00:00"], spark=spark)
    assert res["source_metadata"] == 2 and res["source_drug_events"] > 0


def test_etl_on_empty_input(spark):
    empty = spark.createDataFrame([], IMPORT_RAW)
    star = run_etl(empty)
    assert star.fact.count() == 0 and all(n == 0 for n in star.dim_rows.values())
    r = D.kpi_summary(star).collect()[0]
    assert (r["fact_groups"], r["transactions"], r["total_sales"], r["date_from"]) == (0, 0, 0.0, None)
    assert D.top_drugs(star).count() == 0 and D.recent_records(star).count() == 0


def _etl_rows(spark, path, cities):
    rows = [(str(i), "2024-05-06 10:00:00", "M", f"D{c}", "10.00", "T", "0", "C", c) for i, c in enumerate(cities)]
    spark.createDataFrame(rows, IMPORT_RAW).write.mode("overwrite").parquet(path)
    return path


def test_reload_into_its_own_folder_is_a_new_version(spark, tmp_path, monkeypatch):
    """Ids stay over a reload in place; a load that fails half way leaves the old star to be read."""
    import pytest

    from rxstar import jobs
    from rxstar.operators import fact as load
    from rxstar.plans.warehouse import read_star

    def cities():
        return {r["dimName"]: r["id"] for r in read_star(spark, star).dims["dimCity"].collect()}

    star = str(tmp_path / "star")
    jobs.etl(spark, _etl_rows(spark, str(tmp_path / "one"), ["Oslo", "Turku"]), star)
    assert cities() == {"Oslo": 1, "Turku": 2}
    more = _etl_rows(spark, str(tmp_path / "two"), ["Aalborg", "Turku", "Oslo"])
    with monkeypatch.context() as m:
        m.setattr(load, "write_fact", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.etl(spark, more, star, existing=star)
    assert cities() == {"Oslo": 1, "Turku": 2} and read_star(spark, star).fact.count() == 2
    jobs.etl(spark, more, star, existing=star)
    assert cities() == {"Oslo": 1, "Turku": 2, "Aalborg": 3} and read_star(spark, star).fact.count() == 3
    assert read_star(spark, f"{star}/v00000001").fact.count() == 2


def test_load_removes_its_scratch_tables(spark, tmp_path):
    import os

    from rxstar.functions.materialize import scratch_path

    raw = spark.read.parquet(_etl_rows(spark, str(tmp_path / "raw"), ["Oslo", "Turku"]))
    folder = os.path.dirname(scratch_path(spark, "x")).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    run_etl(raw, out=str(tmp_path / "star"))
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def test_numbering_with_many_groups_needs_no_local_counts(spark, monkeypatch):
    """The offsets made by windows equal those made on the driver, with NULL groups too."""
    from rxstar.functions import numbering

    rows = spark.range(400).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.col("id").alias("k"))
    few = {tuple(r) for r in numbering.number_rows(rows, ["k"], group_cols=["g"], start=10).select("g", "k", "id").collect() if r["g"]}
    monkeypatch.setattr(numbering, "FEW_COUNTS", 0)
    many = {tuple(r) for r in numbering.number_rows(rows, ["k"], group_cols=["g"], start=10).select("g", "k", "id").collect() if r["g"]}
    assert few == many and len(few) == rows.where("g IS NOT NULL").count()
    assert {i for g, _, i in few if g == "g3"} == set(range(11, 11 + sum(1 for x in range(400) if x % 7 == 3)))
    assert sorted(r["id"] for r in numbering.number_rows(rows.select("k"), ["k"]).collect()) == list(range(1, 401))


def test_a_load_counts_its_dimensions_as_it_writes_them(raw):
    star = run_etl(raw)
    assert star.dim_rows == {d: df.count() for d, df in star.dims.items()}
    names = {d: df.agg(F.coalesce(F.sum(F.octet_length("dimName")), F.lit(0))).first()[0] for d, df in star.dims.items() if d != "dimTime"}
    assert {d: star.dim_bytes[d] for d in names} == names
