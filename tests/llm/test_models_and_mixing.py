"""The classifiers by held-out accuracy, mixing by exact accounts, and the edge cases of each."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxstar.llm import labelled, mixing, quality, toxicity
from rxstar.llm.common import crc_mod

DOC = "doc_id long, text string"


# --- classifiers -------------------------------------------------------------------------------


def prose(rng, n=60):
    return " ".join("".join(rng.choices(["an", "ti", "ther", "or", "el", "mo"], k=rng.randint(1, 4))) for _ in range(n))


def junk(rng, n=60):
    return " ".join(w.upper() + "!!" for w in prose(rng, n).split())


def insulting(rng):
    words = prose(rng).split()
    for w in rng.sample(["blockhead", "nitwit", "scoundrel"], 2):
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.mark.parametrize("module,bad", [(quality, junk), (toxicity, insulting)])
def test_classifier_learns_and_is_reproducible(module, bad):
    rng = random.Random(1)
    rows = [((bad if i % 4 == 0 else prose)(rng).encode(), int(i % 4 == 0), 1.0) for i in range(400)]
    train, held = rows[:300], rows[300:]
    model, again = module.fit(train), module.fit(train[::-1])

    def score(m, text):
        return m.score(text) if module is toxicity else m.score(*m.join(*module.features(text)))

    scores = [score(model, t) for t, _, _ in held]
    right = sum((s >= 0.5) == bool(y) for s, (_, y, _) in zip(scores, held)) / len(held)
    assert right >= 0.95
    assert scores == [score(again, t) for t, _, _ in held]
    assert all(0 <= score(model, t) <= 1 for t in (b"", b" \n", b"\xff\xfe", b"x" * 300_000, "é".encode() * 1000))


def test_factorisation_identity():
    """The linear-time score equals the sum over all pairs."""
    rng = np.random.default_rng(2)
    n = quality.HASHED + quality.N_STRUCTURE
    m = quality.Machine(0.3, rng.normal(0, 0.1, n), rng.normal(0, 0.1, (n, quality.RANK)), np.zeros(1), np.ones(1))
    ids, x = rng.choice(n, 9, replace=False), rng.normal(0, 1, 9)
    pairs = sum(m.v[ids[a]] @ m.v[ids[b]] * x[a] * x[b] for a in range(9) for b in range(a))
    assert np.isclose(m.score(ids, x), 1 / (1 + np.exp(-(0.3 + x @ m.w[ids] + pairs))))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_class_or_no_rows(module):
    for rows, want in (([], 0.5), ([(b"a b", 1, 1.0)], 1.0), ([(b"a b", 0, 1.0)], 0.0)):
        m = module.fit(rows)
        s = m.score(b"c") if module is toxicity else m.score(*m.join(*module.features(b"c")))
        assert abs(s - want) < 1e-6


def test_training_sample(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(None, "x"), (50, None)], DOC)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(1, 1), (1, 1), (3, None), (None, 1), (50, 1), (99, 1)], "doc_id long, q int")
    rows = labelled.training_sample(docs, labels, "q", crc_mod("doc_id", 5) != 0, bound=10_000).collect()
    of = {bytes(r["text"]).decode(): (r["y"], r["weight"]) for r in rows}
    assert len(of) == len(rows) and "x" not in of and all(w == 1 for _, w in of.values())
    few = labelled.training_sample(docs, labels, "q", crc_mod("doc_id", 5) != 0, bound=5).collect()
    assert sum(r["y"] == 0 for r in few) == 5 and {r["weight"] for r in few if r["y"] == 0} > {1.0} - {1.0}
    assert labelled.training_sample(docs, labels.limit(0), "q", crc_mod("doc_id", 5) != 0).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_cover_every_row(spark, module):
    rng = random.Random(3)
    model = module.fit([((junk if i % 3 == 0 else prose)(rng).encode(), int(i % 3 > 0), 1.0) for i in range(60)])
    docs = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, prose(rng)), (4, "long " * 50_000)]
    df = spark.createDataFrame([(*d, 1.5, "s") for d in docs], DOC + ", score double, source string")
    out = (module.quality_scores if module is quality else module.toxicity_scores)(df, model)
    got = out.collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert (module.quality_scores if module is quality else module.toxicity_scores)(df.limit(0), model).count() == 0
    if module is quality:
        kept = quality.kept_rows(df, model)
        assert kept.columns == df.columns and kept.filter("doc_id = 4").first()["score"] == 1.5
        assert kept.count() == sum(r["score"] >= quality.CUTOFF for r in got)


def test_toxicity_learns_from_whole_texts(spark):
    """One beginning of over 64 KB for all texts; what differs stands after it."""
    rng = random.Random(6)
    begin = prose(rng, 12_000)
    assert len(begin) > 1 << 16
    docs = [(i, f"{begin} {(insulting if i % 3 == 0 else prose)(rng)}") for i in range(60)]
    df, labels = spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, "toxic", crc_mod("doc_id", 4) >= 0)
    assert model.constant is None and b"nitwit" in model.toxic
    alone = toxicity.fit([(t.encode(), int(i % 3 == 0), 1.0) for i, t in docs])
    assert (model.ordinary, model.toxic) == (alone.ordinary, alone.toxic) and np.allclose(model.weights, alone.weights)


# --- mixing ------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Targets by name: shared by weight, stopped at three times the size, shared again."""
    names = sorted(sizes, key=lambda s: (s is None, "" if s is None else s.encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = {}
    while True:
        rest = [s for s in names if s not in full]
        left = Fraction(sum(sizes.values()) - sum(full.values()))
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(share.get(s, full.get(s))) for s in names}
        full |= {s: 3 * sizes[s] for s in over}


def corpus(rng):
    docs = []
    for s, n in (("a", 30), ("b", 2), ("B", 25), ("é", 40), (None, 20), ("z", 1), ("", 15)):
        docs += [(len(docs) + i, " ".join(["w"] * rng.randint(0, 40)), s) for i in range(n)]
    return docs + [(900, None, "a"), (901, "", "b"), (902, "w " * 3000, "a"), (900, "same row", "B"), (900, "same row", "B"), (None, "no id here", "z")]


def test_mixing_accounts(spark):
    docs = corpus(random.Random(4))
    df = spark.createDataFrame(docs, DOC + ", source string")
    got = mixing.taken(df).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    by_target = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sorted((k[0], round(k[1], 6), sum(v)) for k, v in by_target.items()) == sorted((sizes[s], round(want[s], 6), round(want[s])) for s in sizes)
    again = mixing.taken(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_rows(spark):
    docs = [(*d, True, "extra") for d in corpus(random.Random(5))]
    df = spark.createDataFrame(docs, DOC + ", source string, taken boolean, _id string")
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    words = {}
    for r in rows.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    taken = {}
    for r in mixing.taken(df).collect():
        taken[(r["source_size"], r["target"])] = taken.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert sorted(words.values()) == sorted(v for v in taken.values() if v)


def test_schedule_is_of_low_discrepancy(spark):
    blocks = {"a": 100, "b": 37, "c": 200, "d": 1}
    sources = spark.createDataFrame([(False, s, n) for s, n in blocks.items()], "_no_source boolean, _source string, _blocks long")
    slots = sorted((r["slot"], r["_source"], r["block"]) for r in mixing.schedule(sources, 10, chunk=16).collect())
    assert len({s[0] for s in slots}) == len(slots) == sum(blocks.values())
    for name, n in blocks.items():
        assert [b for _, s, b in slots if s == name] == list(range(n))
        seen = np.cumsum([s == name for _, s, _ in slots])
        assert np.abs(seen - np.arange(1, len(slots) + 1) * n / len(slots)).max() <= 8


def test_mixing_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", "s")], DOC + ", source string")
    assert sorted(tuple(r) for r in mixing.taken(df).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mixed_rows(df).count() == 0 and mixing.taken(df.limit(0)).count() == 0


def test_repeated_ids_among_the_labelled_rows_are_one_example(spark):
    from rxstar.llm.labelled import training_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    sample = training_sample(docs, labels, "quality", F.lit(True), bound=5).collect()
    assert sorted((bytes(r["text"])[:4], r["y"]) for r in sample) == [(b"", 0), (b"b", 0), (b"text", 1)]
    again = training_sample(docs.repartition(7), labels, "quality", F.lit(True), bound=5).collect()
    assert {bytes(r["text"]) for r in again} == {bytes(r["text"]) for r in sample}


def test_training_in_parallel_equals_training_at_once(spark):
    from rxstar.llm import quality

    texts = [(i, " ".join(("good" if i % 2 else "bad") + str((i * k) % 7) for k in range(9)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    model = quality.train(docs, labels, "quality", F.lit(True))
    plain = quality.fit([(t[1].encode(), t[2], 1.0) for t in texts])
    assert model.bias == plain.bias and (model.w == plain.w).all() and (model.v == plain.v).all()
