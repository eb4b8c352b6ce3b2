"""Hot keys: one key holds a third of the rows.  Results stay whole and the plans pre-aggregate."""

import contextlib
import io

from pyspark.sql import functions as F

from rxstar.operators.fact import grain_aggregate
from rxstar.operators.staging import stage_sales
from rxstar.operators.upsert import keep_last
from rxstar.plans.dashboard import top_labels
from rxstar.schemas import IMPORT_RAW


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def hot_rows(spark, n=3000):
    # a third of the rows share one key; the rest are spread over many keys
    return spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
        F.col("id").alias("seq"),
        (F.col("id") * 10).alias("v"),
    ).repartition(6)


def test_keep_last_hot_key_is_partial_and_whole(spark):
    df = hot_rows(spark)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keep_last(df, ["key"], ["seq"])
        p = plan(out)
        got = {r["key"]: r["seq"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert "partial_max" in p and "SortAggregate" not in p  # a key is one row of each task before the shuffle
    assert "hashpartitioning(coalesce(seq" in p  # whole rows are dealt by key and order
    assert got["HOT"] == 2997 and len(got) == 1 + len({i % 97 for i in range(3000) if i % 3})


def test_keep_last_with_null_keys_and_two_order_columns(spark):
    rows = [(None, 1, 9, "a"), (None, 2, 1, "b"), ("k", 1, 5, "c"), ("k", 1, 7, "d"), ("j", None, None, "e")]
    df = spark.createDataFrame(rows, "key string, batch int, seq int, v string")
    assert {(r["key"], r["v"]) for r in keep_last(df, ["key"], ["batch", "seq"]).collect()} == {(None, "b"), ("k", "d"), ("j", "e")}


def test_grain_aggregate_hot_city(spark):
    rows = [(str(i), "2024-01-01 00:00:00", "M", "D", "1.00", "T", "0", "C", "HOT" if i % 3 == 0 else f"c{i % 50}")
            for i in range(3000)]
    grain = grain_aggregate(stage_sales(spark.createDataFrame(rows, IMPORT_RAW).repartition(6)))
    assert "partial_sum" in plan(grain) or "partial_count" in plan(grain)
    hot = grain.where("City = 'HOT'").collect()[0]
    assert hot["cntDrug"] == 1000 and float(hot["sumDrug"]) == 1000.0
    assert grain.agg(F.sum("cntDrug")).collect()[0][0] == 3000


def test_top_labels_hot_label(spark):
    df = hot_rows(spark).withColumnRenamed("key", "labeler_name")
    out = top_labels(df, "labeler_name", "products", limit=3)
    assert "TakeOrderedAndProject" in plan(out) and "partial_count" in plan(out)
    assert out.collect()[0]["label"] == "HOT" and out.collect()[0]["products"] == 1000
