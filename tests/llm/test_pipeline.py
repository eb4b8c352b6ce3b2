"""The registered queries and the pipeline, held against plain implementations on a small table."""

import duckdb
import numpy as np

import __spark_entry__ as E
import corpus_pipeline
from rxstar.llm import queries, quality, simhash
from rxstar.llm.blocks import forest
from rxstar.llm.common import crc_mod, read


def test_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in E.queries()) == 1 for n in names) and "pipeline" in E.queries()


def test_sql_oracles(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        cur = con.execute(sql)
        assert [d[0] for d in cur.description] == df.columns
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_stages_against_plain_code(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    rows = {r["doc_id"]: r for r in docs.collect()}
    (_, first), (_, second), (_, third), (_, fourth), (_, last) = corpus_pipeline.STAGES

    kept = first(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    model = quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), "quality", crc_mod("doc_id", 5) != 0)
    good = {i for i, r in rows.items() if model.score(*model.join(*quality.features((r["text"] or "").encode()))) >= 0.3}
    assert {r["doc_id"] for r in kept.collect()} == good

    unique = second(spark, kept, sf_dir)
    owner = {}
    for i in sorted(good):
        owner[rows[i]["text"] or ""] = i
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == set(owner.values())

    apart = third(spark, unique, sf_dir)
    ids = sorted(owner.values())
    fps = np.array([simhash.fingerprint((rows[i]["text"] or "").encode()) for i in ids], np.uint64)
    root = forest(len(ids), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4))
    stay = {ids[n] for n in range(len(ids)) if root[n] == n}
    assert apart.columns == docs.columns and {r["doc_id"] for r in apart.collect()} == stay

    mixed = fourth(spark, apart, sf_dir)
    assert mixed.columns == docs.columns
    size = {i: len((rows[i]["text"] or "").encode().split()) for i in stay}
    out = mixed.collect()
    assert {r["doc_id"] for r in out} <= stay
    assert abs(sum(len(r["text"].encode().split()) for r in out) - sum(size.values())) <= 20
    assert sum(r["text"] != rows[r["doc_id"]]["text"] for r in out) <= 20  # one cut document in a source at most

    tokens = last(spark, mixed, sf_dir)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and tokens.count() == len(out)


def test_stages_on_odd_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a b", "xx", None, None)], docs.schema)
    for table in (docs.limit(0), odd):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, sf_dir)
            out.collect()
            assert n == 4 or out.columns == docs.columns
