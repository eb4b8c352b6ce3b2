"""Merges into stored tables: which buckets they rewrite, what rows become, and what a failed one leaves."""

import pytest
from pyspark.sql import functions as F

from rxstar.functions.collation import LCASE, fold
from rxstar.operators import buckets as B
from rxstar.operators.upsert import merge_rows


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "table")
    B.create_table(spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"), F.lit("old").alias("t")), path, ["key"], buckets=200)
    return path


def test_a_small_change_rewrites_its_buckets_alone(spark, base):
    before = B.current_buckets(spark, base)
    assert len(before) == 200 and sum(n for _, n in before.values()) == 5000
    changes = spark.createDataFrame([("k17", None, "new"), ("k18", 1, "new"), ("more", 2, "new")], "key string, v long, t string")
    rewritten = B.merge_table(spark, base, changes)
    assert 1 <= len(rewritten) <= 3
    after = B.current_buckets(spark, base)
    assert {b for b in after if after[b][0] == 2} == set(rewritten) and all(after[b] == before[b] for b in after if b not in rewritten)
    assert sum(n for _, n in after.values()) == 5001
    table = B.read_table(spark, base)
    assert rows_of(table.where("t = 'new'")) == {("k17", None, "new"), ("k18", 1, "new"), ("more", 2, "new")}
    assert table.count() == 5001 and table.where("t = 'old'").count() == 4998
    files = [f.split("/data/")[1].split("/")[0] for f in table.inputFiles()]
    assert files.count("version=2") == len(rewritten)


def test_no_change_makes_no_version(spark, base):
    assert B.merge_table(spark, base, B.read_table(spark, base).limit(0)) == {}
    assert {v for v, _ in B.current_buckets(spark, base).values()} == {1}


def test_a_merge_that_fails_leaves_the_table(spark, base, monkeypatch):
    changes = spark.createDataFrame([("k1", 7, "new")], "key string, v long, t string")
    with monkeypatch.context() as m:
        m.setattr(B, "commit_version", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            B.merge_table(spark, base, changes)
    assert B.read_table(spark, base).where("t = 'new'").count() == 0 and B.read_table(spark, base).count() == 5000
    B.merge_table(spark, base, spark.createDataFrame([("k2", 8, "new")], "key string, v long, t string"))  # another bucket
    assert rows_of(B.read_table(spark, base).where("t = 'new'")) == {("k2", 8, "new")} and B.read_table(spark, base).count() == 5000


def test_numbered_merges_keep_ids_and_append_after_the_highest_of_all_buckets(spark, tmp_path):
    base, match = str(tmp_path / "dims"), lambda c: fold(c, LCASE)
    old = spark.createDataFrame([("city", "Oslo", 7), ("city", "Bergen", 2), ("drug", "A", 1)], "dim string, name string, id int")
    B.create_table(old, base, ["dim", "name"], buckets=16, match=match)
    found = spark.createDataFrame([("city", "OSLO"), ("city", "Aalborg"), ("city", "Zagreb"), ("drug", "b"), ("type", "x")], "dim string, name string")
    B.merge_table(spark, base, found, number="id", groups=["dim"], match=match)
    want = {("city", "Oslo", 7), ("city", "Bergen", 2), ("city", "Aalborg", 8), ("city", "Zagreb", 9), ("drug", "A", 1), ("drug", "b", 2), ("type", "x", 1)}
    assert rows_of(B.read_table(spark, base)) == want
    B.merge_table(spark, base, found, number="id", groups=["dim"], match=match)
    assert rows_of(B.read_table(spark, base)) == want


def test_merge_rows(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, key string, v string")
    new = spark.createDataFrame([("b", None), ("c", "z")], "key string, v string")
    assert rows_of(merge_rows(old, new, ["key"], number="id")) == {(1, "a", "x"), (2, "b", None), (3, "c", "z")}
    assert rows_of(merge_rows(old, new, ["key"], keep=["v"], number="id")) == {(1, "a", "x"), (2, "b", "y"), (3, "c", "z")}
    assert rows_of(merge_rows(old.limit(0), new, ["key"], number="id")) == {(1, "b", None), (2, "c", "z")}
    assert rows_of(merge_rows(old, new, ["key"])) == {(1, "a", "x"), (2, "b", None), (None, "c", "z")}
