"""Centroid clustering, line dedup and tokenizer alignment against plain implementations, and their edge cases."""

import hashlib
import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from rxstar.llm import alignment, clustering, line_dedup

DOC = "doc_id long, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- centroid clustering -----------------------------------------------------------------------


def plain_lloyd(rows, clusters, rounds, dims, scale=256, seed=2):
    """{row number: (cluster, distance)} and centroids, in Python's integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"{seed}:{kept[n][0]}".encode()).hexdigest(), kept[n][1]))
    centroids = [list(whole[n]) for n in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids)) for x in whole]

    for _ in range(rounds):
        of = assign()
        for k in range(len(centroids)):
            own = [x for x, (_, c) in zip(whole, of) if c == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, k, d) for (i, _), (d, k) in zip(kept, assign())), key=repr), centroids


@pytest.mark.parametrize("blocks,chunk_rows", [(4, 2048), (1, 7), (3, 16), (50, 5)])
def test_lloyd_against_plain_code(spark, blocks, chunk_rows):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((90, 6)), np.repeat(rng.standard_normal((1, 6)), 60, 0), np.round(rng.standard_normal((30, 6)))])
    rows = [(i % 170, v.tolist()) for i, v in enumerate(x)]  # repeated ids with other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, centroids = clustering.lloyd(df, 7, 4, 6, blocks=blocks, chunk_rows=chunk_rows)
    want, want_centroids = plain_lloyd(rows, 7, 4, 6)
    assert rows_of(got) == want and centroids.tolist() == want_centroids


def test_lloyd_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, []), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [0.25, -0.001]),
            (None, [3.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.3, 7.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, chunk string")
    for clusters in (2, 40):
        got, centroids = clustering.lloyd(df, clusters, 3, 2, blocks=2)
        want, want_centroids = plain_lloyd(rows, clusters, 3, 2)
        assert rows_of(got) == want and centroids.tolist() == want_centroids and len(centroids) == min(clusters, 5)
    got, centroids = clustering.lloyd(df.limit(0), 3, 2, 2)
    assert got.columns == ["vec_id", "cluster", "distance"] and got.count() == 0 and len(centroids) == 0
    nameless = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert rows_of(clustering.lloyd(nameless, 3, 2, 2)[0]) == [(None, 0, 0)]


def test_lloyd_with_huge_components(spark):
    """Beyond 2^53 and 2^63 figures stay exact; a distance that a long cannot hold is null."""
    rows = [(1, [1e300, 0.0]), (2, [1e300, 1.0]), (3, [1e15, 3.0]), (4, [1e15 + 2, 5.0]), (5, [1.5, 1e308]), (6, [2e7, -2e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, centroids = clustering.lloyd(df, 2, 3, 2, blocks=2)
    want, want_centroids = plain_lloyd(rows, 2, 3, 2)
    assert rows_of(got) == [(i, k, d if d < 1 << 63 else None) for i, k, d in want] and centroids.tolist() == want_centroids


@pytest.mark.parametrize("most", [5, 1 << 24, 1 << 29, 1 << 40])
def test_partial_distances_are_exact(most):
    rng = random.Random(most)
    x = np.array([[rng.randint(-most, most) for _ in range(3)] for _ in range(20)])
    c = np.array([[rng.randint(-most, most) for _ in range(3)] for _ in range(4)])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert clustering.partial_distances(x, c, 12).tolist() == want
    packed = clustering.unpack(clustering.pack(clustering.partial_distances(x, c, 12)), 4)
    assert packed.tolist() == want


def test_clustering_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    out = clustering.op11_centroid_clustering(spark, sf_dir)
    cur = con.execute(clustering.OP11_SQL)
    assert [d[0] for d in cur.description] == out.columns and rows_of(out) == sorted(cur.fetchall(), key=repr)
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=repr) == plain_lloyd(rows, 40, 5, 64)[0]


# --- lines -------------------------------------------------------------------------------------

BLANK = " \t\n\x0b\x0c\r"


def plain_lines(rows, least, min_chars=1):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    cut = [(i, (t or "").split("\n")) for i, t in rows]
    docs = Counter(k for _, ls in cut for k in {key(x) for x in ls} if len(k) >= min_chars)
    out = []
    for i, ls in cut:
        kept = [x for x in ls if docs[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made_texts(n=120):
    rng = random.Random(3)
    common = ["Terms of Use", "  terms of use\t", "ÄRGER", "ärger", "", " ", "x", " x", "TERMS OF USE\r", "once " * 20]
    return [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"line {rng.randint(0, 400)}" for _ in range(rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("least,min_chars,max_broadcast", [(10, 1, 1_000_000), (10, 1, 1), (3, 2, 4), (2, 0, 1_000_000), (1, 1, 0)])
def test_line_dedup_against_plain_code(spark, least, min_chars, max_broadcast):
    """Also with nothing broadcast, and with the most frequent lines broadcast alone."""
    rows = made_texts() + [(5, None), (None, "x"), (None, "x"), (7, "Terms of use"), (7, "Terms of use"), (8, "\n\n")]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    assert rows_of(line_dedup.line_dedup(df, least, min_chars, max_broadcast)) == plain_lines(rows, least, min_chars)


def test_deduped_rows_keep_all_columns(spark):
    rows = [(i, f"same\nown {i}", "h", True, i, f"k{i}", 2.5) for i in range(12)] + [(None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC + ", hash string, kept boolean, n_lines int, `a.b` string, row double")
    out = line_dedup.deduped_rows(df)
    assert out.columns == df.columns
    want = [(i, f"own {i}", *r) for i, _, *r in rows[:-1]] + [(None, "", None, None, None, None, None)]
    assert rows_of(out) == sorted(want, key=repr)
    assert line_dedup.deduped_rows(df.limit(0)).count() == 0 and line_dedup.line_dedup(df.limit(0)).count() == 0


def test_a_long_text_takes_time_linear_in_its_lines(spark):
    long = "\n".join(f"c{i % 40000}" if i % 2 else f"u{i}" for i in range(120_000))
    rows = [(0, long)] + [(i, "\n".join(f"c{j}" for j in range(40_000))) for i in range(1, 3)]
    t = time.time()
    got = rows_of(line_dedup.line_dedup(spark.createDataFrame(rows, DOC), 3))
    assert got == plain_lines(rows, 3) and time.time() - t < 60


# --- tokenizer alignment -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    paths = [public_tokenizers.path(v) for v in alignment.VOCABULARIES]
    return alignment.Aligner(alignment.ByteLevel(paths[0]), alignment.Pieces(paths[1]))


def plain_alignment(rows, al):
    """The result, and {(a, b): documents}."""
    per = []
    for i, t in rows:
        a, b = (al.a.tokenizer.encode(" " + t, add_special_tokens=False).ids, al.b.model.encode(t)) if t else ([], [])
        joined = [b"".join(x.tokens[k] for k in ids) for x, ids in ((al.a, a), (al.b, b))]
        if not t or joined != [b" " + t.encode()] * 2:
            per.append((i, 0, 0, [], Counter()))
            continue
        groups, at = [([], [])], [0, 0]
        ia = ib = 0
        while ia < len(a) or ib < len(b):
            if at[0] <= at[1]:
                at[0] += len(al.a.tokens[a[ia]])
                groups[-1][0].append(a[ia])
                ia += 1
            else:
                at[1] += len(al.b.tokens[b[ib]])
                groups[-1][1].append(b[ib])
                ib += 1
            if at[0] == at[1]:
                groups.append(([], []))
        per.append((i, len(a), len(b), groups[:-1], Counter((x, y) for g, h in groups for x in g for y in h)))
    docs = Counter(k for p in per for k in p[4])
    best = Counter()
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for i, n_a, n_b, groups, links in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        top = sum(m for k, m in links.items() if docs[k] == best[k[0]])
        out.append((i, n_a, n_b, len(groups), sum(links.values()), top, sum(m * docs[k] for k, m in links.items()), digest))
    return sorted(out, key=repr), docs


ODD = ["", None, " ", "  ", "a", "a ", "\n", "x\ny\r\n", "<|endoftext|> <s></s> <unk> <0x41>", "▁ under ▁▁bar", "日本語のテキスト、漢字かな交じり文。" * 30,
       "👩‍👩‍👧 emoji 🎉🎉" * 5, "nul\x00byte", "ﬁ ligature Å Å", "   　 wide", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "don't  stop   now    !!", "1234567890 " * 50]


def spoken(n=60):
    rng = random.Random(4)
    words = "the The of tokenizer Straße naïve übermäßig данные 数据 foo_bar 3.14159 antidisestablishmentarianism ... (see) don't\n \t".split(" ")
    return [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("unit_records,radices,fan_in", [(4_000_000, 64, 256), (300, 3, 2), (1, 1, 3)])
def test_alignment_against_plain_code(spark, tokenizers, unit_records, radices, fan_in):
    """Also with units of a few documents and several rounds of merging."""
    rows = list(enumerate(ODD + spoken())) + [(1, "the of the"), (1, "the of the"), (None, "the of"), (None, None)]
    df = spark.createDataFrame([(*r, "e", 1.5) for r in rows], DOC + ", groups_sha256 string, unit double").repartition(2)
    out, table = alignment.align(df, unit_records=unit_records, radices=radices, fan_in=fan_in)
    want, docs = plain_alignment(rows, tokenizers)
    assert rows_of(out) == want
    best = Counter()
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    pairs = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in alignment.pair_counts(table, radices=radices).collect()}
    assert pairs == {k: (n, n == best[k[0]]) for k, n in docs.items()}


def test_alignment_query_on_all_documents(spark, sf_dir, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = alignment.op13_tokenizer_alignment(spark, sf_dir)
    assert rows_of(out) == plain_alignment(rows, tokenizers)[0]
    assert dict(out.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in out.columns}


def test_alignment_of_nothing(spark):
    out, table = alignment.align(spark.createDataFrame([], DOC))
    assert out.count() == 0 and table.count() == 0
    assert rows_of(alignment.align(spark.createDataFrame([(1, None)], DOC))[0]) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_words_have_the_tokens_that_the_text_has(tokenizers):
    assert tokenizers.b.cuts_before_spaces()
    for text in [*(t for t in ODD if t), " ".join(t for t in ODD[2:] + spoken(200) if t) + "  \n end "]:
        cut = alignment.words(text)
        assert " ".join(cut) == text
        whole = [x.encode([text])[0] for x in (tokenizers.a, tokenizers.b)]
        assert [[i for ids in x.encode(cut) for i in ids] for x in (tokenizers.a, tokenizers.b)] == whole
        if next(tokenizers.encode([text])) is not None:
            a, b, n_a, n_b = tokenizers.encode_words(cut)
            assert [a.tolist(), b.tolist()] == whole and n_a.sum() == len(a) and len(n_b) == len(cut)


def test_both_libraries_give_the_same_tokens(tokenizers):
    """Every 97th character between letters, digits, signs and white space, and the odd texts."""
    assert tokenizers.a.fast is not None
    chars = [chr(c) for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000)]
    mixed = [f"a{c}b 1{c}2 !{c}! {c}{c} {c}a {c}1\n{c}\n {c}  '{c}s" for c in chars]
    texts = ["".join(mixed[i : i + 50]) for i in range(0, len(mixed), 50)] + [t for t in ODD if t] + spoken(100)
    want = [tokenizers.a.tokenizer.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert tokenizers.a.encode(texts) == want


def test_words_are_forgotten_beyond_the_bound(tokenizers, monkeypatch):
    rows = list(enumerate(ODD + spoken(30)))
    raw = [(t or "").encode() for _, t in rows] + [b"\xff broken", b"a\xff"]
    kept = alignment.Words(tokenizers)
    want = kept.texts(raw)[0]
    assert want[-1] == want[-2] == (0, 0, 0, 0, "")
    monkeypatch.setattr(alignment, "MAX_WORDS", 3)
    small = alignment.Words(tokenizers)
    assert [r for t in raw for r in small.texts([t])[0]] == want and len(small.number) < 200


@pytest.mark.parametrize("most", [1, 6, 1 << 20])
def test_links_of_large_groups(tokenizers, most):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50_000, 60), rng.integers(0, 5, 70)
    n_a, n_b = np.array([1, 20, 2, 37]), np.array([2, 30, 1, 37])
    got = Counter()
    of = Counter()
    for group, pairs, n in tokenizers.links(a, b, n_a, n_b, most):
        for g, m in zip(group, np.ones(len(pairs), int) if n is None else n):
            of[int(g)] += int(m)
        for x, y, m in zip(*tokenizers.ids(pairs), np.ones(len(pairs), int) if n is None else n):
            got[int(x), int(y)] += int(m)
    want, i, j = Counter(), 0, 0
    for p, q in zip(n_a, n_b):
        want.update((int(x), int(y)) for x in a[i : i + p] for y in b[j : j + q])
        i, j = i + p, j + q
    assert got == want and of == dict(enumerate((n_a * n_b).tolist()))


def test_heap_merge():
    rng = random.Random(6)
    runs = [dict.fromkeys((rng.randint(0, 400) for _ in range(rng.randint(1, 90))), 1 + k) for k in range(9)]
    frames = []
    for r in runs:
        pairs = np.array(sorted(r))
        docs = np.array([r[int(p)] for p in pairs])
        frames.append([alignment.pack_keys(pairs[i : i + 7], docs[i : i + 7]) for i in range(0, len(pairs), 7)])
    out = list(alignment.merged(frames, 4))
    got = {int(p): int(d) for pairs, docs in out for p, d in zip(pairs, docs)}
    want = Counter()
    for r in runs:
        want.update(r)
    assert got == want and [int(p) for pairs, _ in out for p in pairs] == sorted(want)
    assert len({int(p[0]) >> 4 for p, _ in out}) == len(out) and all(len({int(x) >> 4 for x in p}) == 1 for p, _ in out)
