"""Exact, SimHash and embedding deduplication against brute force, and the edge cases of each."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from rxstar.llm import blocks, components, embedding_dedup, exact_dedup, simhash, trie

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, "x" * 200_000), (5, "x" * 200_000), (6, " \n")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- tries -------------------------------------------------------------------------------------


def test_trie_holds_what_was_put_in():
    rng = random.Random(1)
    keys = {bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(300)} | {b"", b"\xff\x00"}
    t = trie.Trie()
    for n, k in enumerate(sorted(keys, key=lambda k: hashlib.md5(k).digest())):
        t.node(k).owner = k
    assert sorted(k for k, _ in t.items()) == sorted(keys) and all(k == v for k, v in t.items())


@pytest.mark.parametrize("a,b,n", [(b"", b"", 0), (b"abc", b"abd", 2), (b"abc", b"abc", 3), (b"abcd", b"ab", 2), (b"x", b"y", 0)])
def test_shared_prefix(a, b, n):
    assert trie.shared_prefix(a, b) == n


# --- exact dedup -------------------------------------------------------------------------------


@pytest.mark.parametrize("budget,bits", [(exact_dedup.BUDGET, 20), (1000, 0)])
def test_text_owners_spill_and_hash_collisions(spark, budget, bits):
    """With one hash bucket and a tiny budget tries hold many texts and spill all the time."""
    rng = random.Random(2)
    docs = [(i, "t" + "".join(rng.choices("ab", k=rng.randint(0, 6)))) for i in range(500)]
    df = spark.createDataFrame(docs, DOC).repartition(3)
    got = {r["_sha"]: (r["_owner"], r["_rows"]) for r in exact_dedup.text_owners(df, "largest", budget, bits).collect()}
    want = {}
    for i, t in docs:
        want.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    assert got == {k: (max(v), len(v)) for k, v in want.items() if len(v) > 1}


def test_exact_dedup_edge_cases(spark):
    df = spark.createDataFrame([(*r, "u", True, 7) for r in ODD], DOC + ", keep_id string, kept boolean, _x int")
    out = exact_dedup.exact_dedup(df).collect()
    assert len(out) == len(ODD)
    kept = [(r["doc_id"], r["text"]) for r in out if r["kept"]]
    assert sorted(kept, key=repr) == sorted([(2, ""), (3, "a b c d e"), (5, "x" * 200_000), (6, " \n")], key=repr)
    assert {r["group_size"] for r in out if r["text"] == "a b c d e"} == {3}
    same = exact_dedup.kept_rows(df)
    assert same.columns == df.columns and same.count() == 4
    small = {r["doc_id"] for r in exact_dedup.exact_dedup(df, "smallest").filter("kept").collect()}
    assert small == {1, 3, 4, 6}
    assert exact_dedup.kept_rows(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "q"), (None, "q")], DOC)
    assert exact_dedup.kept_rows(nameless).count() == 1


# --- components --------------------------------------------------------------------------------


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, 1000 + i) for i in range(1, 60)]
    edges += [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(40)]
    df = spark.createDataFrame(edges + [(None, 5), (7, 7)], "u long, v long")
    got = {r[0]: r[1] for r in components.components(df).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])
    assert components.components(df.limit(0)).count() == 0


def test_units_bring_every_pair_together_once(spark):
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(1, i) for i in range(5)], "key int, id long")
    seen = {}
    for r in blocks.units(rows, ["key"], "id", 8).collect():
        seen.setdefault((r["key"], r["_i"], r["_j"]), ([], []))[r["_side"]].append(r["id"])
    pairs = [(k[0], *sorted(p)) for k, (a, b) in seen.items() for p in ([(x, y) for x in a for y in b] if k[1] != k[2] else [(x, y) for x in a for y in a if x < y])]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2 + 5 * 4 // 2
    assert max(len(a) + len(b) for a, b in seen.values()) <= 40


# --- SimHash -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = bytes(text, "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    texts = ["", None, "One", "A b C d", "a b c d e É f\tg\x0bh\u00a0i", "w " * 5000, " ".join(map(str, range(700)))]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t or "") for i, t in enumerate(texts)}
    assert got[0] == got[1] == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 6])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (40, 5, 8)).astype(np.uint64))
    fps = np.concatenate([base] + [np.bitwise_xor.reduce(flips[:, k, : k + 3], axis=1) ^ base for k in range(5)])
    q, lane = simhash.close_pairs(fps[:100], fps, radius)
    want = np.argwhere(np.bitwise_count(fps[:100, None] ^ fps[None, :]) <= radius)
    assert sorted(zip(q, lane)) == sorted(map(tuple, want))


@pytest.mark.parametrize("rows", [10, 10**6, 10**9])
def test_tables_lose_no_pair(rows):
    masks = simhash.tables_for(rows)
    rng = random.Random(5)
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == 0 for m in masks)


def test_simhash_groups_against_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(5)] + base + [0, 0]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    marks = spark.createDataFrame(list(enumerate(signed)) + [(None, signed[0])], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_groups(marks, cap=16).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = {i: i for i in range(len(fps))} | union_find(links)
    assert all(got[f] == want[i] for i, f in enumerate(signed))


def test_simhash_edge_cases(spark):
    df = spark.createDataFrame([(*r, 9, "k") for r in ODD], DOC + ", fp int, component_id string")
    out = simhash.simhash_dedup(df).collect()
    assert len(out) == len(ODD)
    of = {r["doc_id"]: r for r in out}
    assert of[1]["component_id"] == of[2]["component_id"] == of[6]["component_id"] == 1 and of[1]["fingerprint"] == "0" * 16
    assert of[5]["component_id"] == 4 and not of[5]["kept"] and of[4]["kept"]
    kept = simhash.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 3, 4]
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


def test_simhash_rows_with_repeated_and_null_ids(spark):
    """A clean text stays though another row of its id is a near copy; one of the near copies without an id stays."""
    words = [f"w{i}" for i in range(400)]
    copy, other, third = " ".join(words), " ".join(words[::-1]), " ".join(words[::7] + words[3::5])
    rows = [(0, copy), (1, copy + " end"), (1, other), (None, third), (None, third + " end")]
    assert (simhash.fingerprint(copy.encode()) ^ simhash.fingerprint((copy + " end").encode())).bit_count() <= 4
    near = (simhash.fingerprint(third.encode()) ^ simhash.fingerprint((third + " end").encode())).bit_count() <= 4
    kept = [tuple(r) for r in simhash.kept_rows(spark.createDataFrame(rows, DOC)).collect()]
    assert near and sorted(kept, key=repr)[:2] == [(0, copy), (1, other)]
    assert sum(i is None for i, _ in kept) == 1 and len(kept) == 3


# --- embeddings --------------------------------------------------------------------------------


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((120, 24))
    x = np.concatenate([base, base[:60] + rng.standard_normal((60, 24)) * 0.25, base[:1].repeat(30, 0), base[1:2] * 2.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, recall=0.999999, cap=32).collect()}
    near = embedding_dedup.linked(x, x, 0.9)
    np.fill_diagonal(near, False)
    root = blocks.forest(len(x), *np.nonzero(near))
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()
    assert [got[i]["kept"] for i in range(len(x))] == (root == np.arange(len(x))).tolist()


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
               (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, -0.0]), (2, [1.0, 0.0]), (11, [1e-300, 0.0])]
    df = spark.createDataFrame([(*v, 3, "c") for v in vectors], "vec_id long, embedding array<double>, n_links int, links string")
    out = sorted((tuple(r) for r in embedding_dedup.embedding_dedup(df).collect()), key=repr)
    near = {(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (11, 4, 1, False)}
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)} | {(None, 0, None, False)}
    assert set(out) == near | alone and len(out) == len(vectors)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_tables_reach_the_recall():
    for rows in (1, 1000, 10**6, 10**9):
        bits, tables = embedding_dedup.plan_tables(rows)
        p = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - p) ** tables >= 0.999


# --- columns of any name, repeats, recall ------------------------------------------------------


def test_kept_rows_give_a_documents_own_columns_back(spark):
    """Whatever a document's columns are called: their values stay, in every filtering stage."""
    from rxstar.llm import quality

    names = ["keep_id", "kept", "group_size", "text_sha256", "_len", "_rows", "_sha", "_text", "_gone", "_row", "_hash", "_id", "_score", "_scored", "fp", "a.b"]
    rows = [(i, " ".join(f"w{(i // 2) * 40 + k}" for k in range(40)), *[f"{n}{i}" for n in names]) for i in range(8)]
    df = spark.createDataFrame(rows, DOC + ", " + ", ".join(f"`{n}` string" for n in names))
    odd = [r for r in rows if r[0] % 2]
    assert sorted(map(tuple, exact_dedup.kept_rows(df).collect())) == odd
    assert sorted(map(tuple, simhash.kept_rows(df).collect())) == [r for r in rows if not r[0] % 2]
    assert sorted(map(tuple, quality.kept_rows(df, quality.fit([])).collect())) == rows
    own = exact_dedup.exact_dedup(df.drop("keep_id", "kept", "group_size", "text_sha256")).collect()
    assert {(r["doc_id"], r["_len"], r["a.b"]) for r in own} == {(r[0], f"_len{r[0]}", f"a.b{r[0]}") for r in rows}


def test_repeated_rows_keep_their_own_columns(spark):
    rows = [(1, "same", f"n{i}") for i in range(50)] + [(0, "same", "small"), (2, "other", "x")]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOC + ", note string").repartition(4)).collect()
    assert sorted(r["note"] for r in out) == sorted(r[2] for r in rows)
    assert sum(r["kept"] for r in out) == 2 and {r["group_size"] for r in out if r["text"] == "same"} == {51}


def test_tries_of_documents_share_what_texts_begin_with(spark, sf_dir):
    """By production keys, tries hold many texts and have split edges."""
    docs = [(r[0] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    tries = {}
    for text in set(docs):
        key = len(text) // exact_dedup.CLASS_BYTES, xxhash.xxh64_intdigest(text) & ((1 << exact_dedup.HASH_BITS) - 1)
        tries.setdefault(key[0] // 8, trie.Trie()).node(text).owner = text
    sizes = [sum(1 for _ in t.items()) for t in tries.values()]
    assert max(sizes) > 5

    def split_edges(node):
        return sum((child.owner is None) + split_edges(child) for _, child in node.edges.values())

    assert sum(split_edges(t.root) for t in tries.values()) > 0


def test_embeddings_with_one_id_and_different_vectors(spark):
    """Each row has its own links; components are not joined by an id."""
    near = [0.999, 0.04, 0.0]
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, near), (3, [0.02, 0.999, 0.0]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df, recall=0.999999).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_recall_at_the_threshold(spark):
    """At the default settings nearly all links at a cosine of 0.900 to 0.910 are found."""
    rng = np.random.default_rng(11)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = rng.uniform(0.9005, 0.91, (1500, 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links = sum(r["n_links"] for r in embedding_dedup.embedding_dedup(df).collect())
    assert links >= 0.99 * (embedding_dedup.linked(x, x, 0.9).sum() - len(x))
