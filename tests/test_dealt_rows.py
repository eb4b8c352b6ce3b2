"""What is dealt out between executors, and how often: loads deal narrow rows, once for each key they need."""

import contextlib
import datetime
import glob

from rxstar import registry
from rxstar.functions import numbering
from rxstar.functions.materialize import materialize
from rxstar.operators import fact as load
from rxstar.operators.upsert import keep_last
from rxstar.schemas import FACT_STORED, IMPORT_RAW
from rxstar.sources import fixtures, landing


@contextlib.contextmanager
def no_broadcast(spark):
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def dealt(df):
    """(keys, columns) of each shuffle in the plan."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.initialPlan())
            continue
        if node.nodeName() == "Exchange":
            found.append((node.outputPartitioning().toString(), node.output().toString()))
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


DAY = datetime.datetime(2020, 1, 2)


def tables(spark, root, *, orders, lines):
    part = [(k, f"red ring {k}", f"Brand#{k}", "SMALL", k) for k in (1, 2)]
    for name, rows, schema in (
        ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, "
                            "l_linestatus string, l_shipdate timestamp_ntz"),
        ("customer", [(1, 7), (2, 8)], "c_custkey long, c_nationkey int"),
        ("nation", [(7, "SEVEN"), (8, "EIGHT")], "n_nationkey int, n_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def order(key, cust=1):
    return key, cust, "F", DAY, "1-URGENT"


def line(key, part, number):
    return key, part, 5, number, 10.5, "N", "F", DAY


def test_event_pages_deal_table_columns_once(spark, tmp_path):
    d = tables(
        spark, tmp_path,
        orders=[order(1), order(1, 2), order(2), order(103), order(None)],  # an order twice, one without lines, one without a key
        lines=[line(1, 2, 2), line(1, 1, 1), line(103, 1, 1), line(7, 1, 1), line(None, 1, 1), line(1, 9, 3)],
    )
    pages = landing.event_pages(spark, d)
    by_page = [columns for keys, columns in dealt(pages) if "skip" in keys]
    assert len(by_page) == 1 and not any("l_orderkey" in keys for keys, _ in dealt(pages))
    got = {p["skip"]: p for p in pages.collect()}
    assert set(got) == {0, 100, None} and all(p["meta"]["results"]["total"] == 5 for p in got.values())
    drugs = [(r["safetyreportid"], r["patient"]["drug"] and [x["medicinalproduct"] for x in r["patient"]["drug"]]) for r in got[0]["results"]]
    assert drugs == [("1", ["red ring 1", "red ring 2"]), ("1", ["red ring 1", "red ring 2"]), ("2", None)]
    assert [r["patient"]["drug"][0]["openfda"]["manufacturer_name"] for r in got[100]["results"]] == [["Supplier-5"]]
    assert [r["patient"]["drug"] for r in got[None]["results"]] == [None]


def test_a_source_is_loaded_by_itself_from_compressed_pages(spark, tmp_path):
    spark.createDataFrame(
        [(k, f"red ring {k}", "Brand#1", "SMALL", 1 + k % 2) for k in range(5)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(f"{tmp_path}/part.parquet")  # no other table is there
    d = str(tmp_path)
    assert {r["product_ndc"] for r in registry.stored(spark, d, "source_ndc_products").collect()} == {"Brand#1-001", "Brand#1-002"}
    pages = glob.glob(f"{landing.landed_page_set(spark, d, 'ndc')}/part-*")
    assert pages and all(p.endswith(".json.gz") for p in pages)


def test_sales_rows_are_dealt_for_their_own_keys_only(spark, tmp_path):
    d = tables(spark, tmp_path, orders=[order(1), order(2, 2)], lines=[line(1, 1, 1), line(2, 2, 1), line(2, 9, 2)])
    with no_broadcast(spark):
        sales = fixtures.raw_sales(spark, d, "A")
        with_price = [keys for keys, columns in dealt(sales) if "l_extendedprice" in columns and "xxhash64" not in keys]
        assert not any("cust" in keys for keys in with_price)
        got = sorted((r["Transaction_ID"], r["City"], r["Drug_Name"]) for r in sales.collect())
    assert got == [("1-1", "SEVEN", "red ring 1"), ("2-1", "EIGHT", "red ring 2")]


def test_keep_last_deals_whole_rows_once(spark):
    rows = [("k", 1, 5, 0, "c"), ("k", 1, 7, 0, "d"), ("k", 1, 7, 1, "e"), ("k", None, 9, 9, "f"), (None, 2, 1, 0, "g"), (None, 1, 9, 9, "h"),
            ("j", None, None, None, "i")]
    df = spark.createDataFrame(rows, "key string, run long, seq long, batch long, v string")
    with no_broadcast(spark):
        out = keep_last(df, ["key"], ["run", "seq", "batch"])
        assert sum(" v#" in f" {columns}".replace(",", ", ").replace("(", " ") for _, columns in dealt(out)) == 1
        assert sorted((r["key"] or "", r["v"]) for r in out.collect()) == [("", "g"), ("j", "i"), ("k", "e")]


def test_star_load_stores_the_grain_once_and_deals_no_mean(spark, monkeypatch):
    stored = []

    def noted(df, label):
        stored.append((label, set(df.columns)))
        return materialize(df, label)

    monkeypatch.setattr(load, "materialize", noted)
    monkeypatch.setattr(numbering, "materialize", noted)
    rows = [("1", "2020-01-02 00:00:00", "M", "D", "1.00", "T", "0", "C", "X"), ("2", "2020-01-02 10:00:00", "M", "D", "1.50", "T", "0", "C", "X"),
            ("3", "2021-01-02 00:00:00", "M", "E", "7.00", "T", "1", "C", "X"), ("4", None, "M", "E", "7.00", "T", "1", "C", "X")]
    star = load.run_etl(spark.createDataFrame(rows, IMPORT_RAW))
    of_fact = [(label, columns) for label, columns in stored if "cntDrug" in columns]
    assert [label for label, _ in of_fact] == ["grain", "numbered"] and not any("avgDrug" in columns for _, columns in of_fact)
    assert {f.name: f.dataType for f in star.fact.schema} == {f.name: f.dataType for f in FACT_STORED}
    got = sorted((r["cntDrug"], float(r["sumDrug"]), r["avgDrug"], r["id"]) for r in star.fact.collect())
    assert got == [(1, 7.0, 7.0, 2), (2, 2.5, 1.25, 1)]
    twice = load.run_etl(spark.createDataFrame(rows, IMPORT_RAW), measure="double")
    assert sorted(r["avgDrug"] for r in twice.fact.collect()) == [1.25, 7.0]


def test_scratch_tables_and_landed_sales_are_compressed(spark, tmp_path):
    assert all(".zstd." in f for f in materialize(spark.range(10), "some").inputFiles())
    d = tables(spark, tmp_path, orders=[order(1)], lines=[line(1, 1, 1)])
    landed = fixtures.landed_raw_sales(spark, d, "A")
    assert landed.count() == 1 and all(".zstd." in f for f in landed.inputFiles())
