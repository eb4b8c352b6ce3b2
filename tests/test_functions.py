"""Column functions: one test per staging quirk (K-numbers of the survey)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxstar.functions import cleaning as C
from rxstar.functions.exact import ratio, round2_double
from rxstar.functions.numbering import number_rows


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def test_timestamp_parse_iso_loose_and_bad(spark):
    df = one_col(spark, ["2024-01-05 07:08:09", "2024-01-05", "2024-1-5 7:8:9", "2024-01-05x", "junk", None])
    got = [r[0] for r in df.select(C.parse_sale_timestamp(F.col("x"))).collect()]
    assert got[0] == dt.datetime(2024, 1, 5, 7, 8, 9)
    assert got[1] == dt.datetime(2024, 1, 5)
    assert got[2] == dt.datetime(2024, 1, 5, 7, 8, 9)  # unpadded parts take the loose format
    assert got[3:] == [None, None, None]


def test_trim_spaces_not_tabs(spark):
    got = [r[0] for r in one_col(spark, ["  a  ", "\tb\t", ""]).select(C.trim_spaces(F.col("x"))).collect()]
    assert got == ["a", "\tb\t", ""]  # K9: empty stays an empty string


def test_price_decimal_comma_and_bad(spark):
    df = one_col(spark, ["12,345", "12.3", "1,234.50", "n/a", None])
    got = [r[0] for r in df.select(C.parse_price(F.col("x"))).collect()]
    assert got == [Decimal("12.35"), Decimal("12.30"), None, None, None]  # K15


def test_refund_flag_words(spark):
    df = one_col(spark, [" Yes ", "TRUE", "t", "1", "y", "no", "0", "", None, "2"])
    got = [r[0] for r in df.select(C.normalize_flag(F.col("x"))).collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_truncate_whole_text_prefix(spark):
    text = "é" * 1500
    got = one_col(spark, [text, None]).select(C.truncate_text(F.col("x"))).collect()
    assert got[0][0] == "é" * 1000 and got[1][0] is None


def test_list_to_text_and_first_of_list(spark):
    df = spark.createDataFrame([(["ORAL", "TOPICAL"],), ([],), (None,)], "x array<string>")
    got = [r[0] for r in df.select(C.list_to_text(F.col("x"), df.schema["x"].dataType)).collect()]
    assert got == ["ORAL, TOPICAL", "", None]
    firsts = [r[0] for r in df.select(C.first_of_list(F.col("x"))).collect()]
    assert firsts == ["ORAL", None, None]  # K10: first([]) is NULL


def test_blank_to_label_and_first_present(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), ("", None)], "a string, b string")
    labels = [r[0] for r in df.select(C.blank_to_label(F.col("a"))).collect()]
    assert labels == ["Unknown", "Unknown", "a", "Unknown"]
    firsts = [r[0] for r in df.select(C.first_present(F.col("a"), F.col("b"))).collect()]
    assert firsts == ["b", "b", "a", None]


def test_ratio_keeps_all_digits(spark):
    df = spark.createDataFrame(
        [(Decimal("2.01"), 2), (Decimal("0.01"), 32), (Decimal("4.00"), 3), (Decimal("1.00"), 0), (None, None)],
        "n decimal(20,2), d long",
    )
    got = [r[0] for r in df.select(ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [1.005, 0.0003125, 1.3333333333333333, 0.0, 0.0]


def test_round2_double_rounds_decimal_digits(spark):
    df = spark.createDataFrame([(1.005,), (5.005,), (2.344999,), (None,)], "x double")
    got = [r[0] for r in df.select(round2_double(F.col("x"))).collect()]
    assert got == [Decimal("1.01"), Decimal("5.01"), Decimal("2.34"), None]


def test_number_rows_matches_row_number(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 1000).alias("k")).distinct().repartition(5)
    got = number_rows(df, ["k"]).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(1, len(got) + 1))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_number_rows_groups_and_start(spark):
    rows = [(g, f"n{i:03d}", 10 if g == "a" else 0) for g in ("a", "b", "c") for i in range(40 if g != "c" else 3)]
    df = spark.createDataFrame(rows, "g string, name string, s int").repartition(4)
    got = number_rows(df, ["name"], start=F.col("s"), group_cols=["g"], id_type=T.IntegerType()).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["name"], r["id"]))
    for g, pairs in by_group.items():
        pairs.sort()
        base = 10 if g == "a" else 0
        assert [i for _, i in pairs] == list(range(base + 1, base + len(pairs) + 1))


def test_timestamp_parse_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # 02:30 on 2024-03-10 does not exist in New York; as a wall-clock value it must survive
        got = one_col(spark, ["2024-3-10 2:30:0", "2024-03-10 02:30:00"]).select(
            C.parse_sale_timestamp(F.col("x"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [r[0] for r in got] == [dt.datetime(2024, 3, 10, 2, 30)] * 2


def test_bounded_broadcast_checks_rows_and_bytes(spark):
    from rxstar.functions.joins import bounded_broadcast

    df = spark.range(3)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(bounded_broadcast(df, rows=3, text_bytes=30))
    assert not hinted(bounded_broadcast(df, rows=3, text_bytes=1 << 30))  # a gigabyte of names is not broadcast
    assert not hinted(bounded_broadcast(df, rows=5_000_000, text_bytes=0))
    assert not hinted(bounded_broadcast(df, rows=None))


def test_spread_only_small_scans(spark):
    from rxstar.sources.tables import spread

    want = spark.sparkContext.defaultParallelism
    one = spark.range(0, 100, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == want
    many = spark.range(0, 100, numPartitions=want * 2)
    assert spread(many) is many  # already spread: no extra shuffle
