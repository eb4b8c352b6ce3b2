"""Quality classifier: a factorisation machine.

Features of a text are hashed words (log counts, scaled to unit length) and statistics of its
structure (standardised); metadata are those that follow from the text alone (its length).  The
score is the logistic function of

    bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

whose last term is all pairwise interactions in time linear in the features.  Training is AdaGrad
on a bounded sample (``labelled.MAX_OF_CLASS`` rows of each class, in one task); scoring runs
over all texts in parallel with the broadcast model of a fixed size.

Null text counts as empty.  Empty texts are scored by the structure alone.  Repeated rows score
alike.  Without labels of both classes the score is the share of label 1 (0.5 without any).  An
empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import crc_mod, fixed_rows, read, ship, texts
from .labelled import training_sample

HASHED = 1 << 15
RANK = 8
EPOCHS = 8
BATCH = 64
RATE = 0.08
L2 = 1e-5
CUTOFF = 0.3
#: Byte classes: other, white space, letters a-z, A-Z, digits, other ASCII, bytes over 127.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 6
_CLASS[:9] = _CLASS[14:32] = 0
_END = b".,;:!?\"')"


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Statistics of the structure of a text, most of them shares from 0 to 1."""
    n, w = max(len(text), 1), max(len(words), 1)
    chars = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    odd = [sum(c.isascii() and not c.isalnum() for c in x.decode("utf-8", "replace") if not c.isspace()) / max(len(x), 1) for x in _spread(lines)]
    upper = [x.isupper() for x in _spread(lines)]
    symbols = sum(len(x) > 0 and not (x[-1:].isalnum() or x[-1] > 127 or x[-1:] in _END) for x in words)
    doubled = sum(x.endswith((b"!!", b"??", b"..", b"**", b"##", b"$$", b"%%", b"&&")) for x in words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / w, *chars.tolist(),
        len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / m, m / w,
        symbols / w, doubled / w, again / w,
        sum(x.isupper() for x in words) / w, sum(x[:1].isupper() for x in words) / w, sum(len(x) == 1 for x in words) / w,
        max(odd, default=0.0), float(np.mean(odd)) if odd else 0.0, float(np.mean(upper)) if upper else 0.0, float(any(upper)),
        min(50.0, again), min(50.0, float(symbols)), min(50.0, float(doubled)),
    ]


def _spread(lines: list[bytes], most: int = 64) -> list[bytes]:
    """At most about ``most`` joined portions that together hold all lines."""
    step = -(-len(lines) // most) or 1
    return [b"\n".join(lines[i : i + step]) for i in range(0, len(lines), step)]


N_STRUCTURE = len(structure(b"", [], Counter()))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(hashed words, their values, structure)."""
    words = text.split()
    counts = Counter(words)
    folded: dict[int, int] = {}
    for word, c in counts.items():
        h = zlib.crc32(word.lower().strip(b".,")) % HASHED
        folded[h] = folded.get(h, 0) + c
    x = np.log1p(np.fromiter(folded.values(), np.float64, len(folded)))
    x /= max(float(np.sqrt((x * x).sum())), 1e-12)
    return np.fromiter(folded, np.int64, len(folded)), x, structure(text, words, counts)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def join(self, ids: np.ndarray, x: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((np.asarray(stats) - self.mean) / self.scale, -4, 4) / 2
        return np.concatenate((ids, HASHED + np.arange(N_STRUCTURE))), np.concatenate((x, z))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.v[ids]
        s = x @ v
        z = self.bias + x @ self.w[ids] + 0.5 * float(s @ s - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[tuple[bytes, int, float]], seed: int = 3) -> Machine:
    """Train on (text, label, weight)."""
    return fit_features([example(*r) for r in rows], seed)


def example(text: bytes, y: int, weight: float) -> tuple:
    """What training needs of a text: its place in the order, label, weight and features."""
    return zlib.crc32(text), hashlib.sha256(text).digest(), y, weight, *features(text)


def fit_features(rows: list[tuple], seed: int = 3) -> Machine:
    """Train on ``example`` rows; they are taken in an order that depends on them alone."""
    rows = sorted(rows, key=lambda r: r[:4])
    y, weight = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
    share = float((y * weight).sum() / weight.sum()) if rows else 0.5
    raw = [r[4:] for r in rows]
    stats = np.array([r[2] for r in raw]) if raw else np.zeros((1, N_STRUCTURE))
    rng = np.random.default_rng(seed)
    size = HASHED + N_STRUCTURE
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)), stats.mean(0), np.maximum(stats.std(0), 1e-6))
    if not 0 < share < 1 or not rows:  # nothing to tell apart: the share itself
        m.v[:] = 0
        m.bias = 0.0 if not rows else 40.0 if share else -40.0
        return m
    m.bias = float(np.log(share / (1 - share)))
    data = [m.join(*r) for r in raw]
    weight = weight / weight.mean()
    g_w, g_v, g_b = np.full(size, 1e-3), np.full((size, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            rows_at = order[at : at + BATCH]
            ids = np.concatenate([data[i][0] for i in rows_at])
            x = np.concatenate([data[i][1] for i in rows_at])
            lens = np.array([len(data[i][0]) for i in rows_at])
            cut = np.cumsum(lens) - lens
            vx = m.v[ids] * x[:, None]
            s = np.add.reduceat(vx, cut)
            z = m.bias + np.add.reduceat(m.w[ids] * x, cut) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), cut))
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows_at]) * weight[rows_at] / len(rows_at)
            each = np.repeat(slope, lens)
            d_v = each[:, None] * (x[:, None] * np.repeat(s, lens, axis=0) - vx * x[:, None])
            used, place = np.unique(ids, return_inverse=True)
            sum_w = np.bincount(place, each * x, len(used)) + L2 * m.w[used]
            sum_v = np.stack([np.bincount(place, d_v[:, f], len(used)) for f in range(RANK)], 1) + L2 * m.v[used]
            g_w[used] += sum_w**2
            g_v[used] += sum_v**2
            g_b += slope.sum() ** 2
            m.w[used] -= RATE * sum_w / np.sqrt(g_w[used])
            m.v[used] -= RATE * sum_v / np.sqrt(g_v[used])
            m.bias -= RATE * slope.sum() / np.sqrt(g_b)
    return m


_EXAMPLE = "crc long, sha binary, y int, weight double, ids array<long>, x array<double>, stats array<double>"


def _example_task() -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _EXAMPLE.split(", ")]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in fixed_rows(batches, 64):
            rows = [example(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _fit_task() -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for crc, sha, y, weight, ids, x, stats in zip(*(c.to_pylist() for c in b.columns)):
                rows.append((crc, sha, y, weight, np.array(ids, np.int64), np.array(x), stats))
        model = fit_features(rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, rows) -> Machine:
    """Features are made where the sampled texts are; one task fits on these (at most so many
    hashed words each); only the model (fixed size) reaches the driver."""
    ship(docs.sparkSession)
    sample = training_sample(docs, labels, label, rows).mapInArrow(_example_task(), _EXAMPLE)
    row = sample.repartition(1).mapInArrow(_fit_task(), "model binary").first()
    return pickle.loads(row[0]) if row else fit([])


def _score_task(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in fixed_rows(batches, 1024):
            scores = [model.score(*model.join(*features(t))) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def quality_scores(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"))
    return rows.mapInArrow(_score_task(shared), "doc_id long, score double")


def kept_rows(docs: DataFrame, model: Machine, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score at least ``cutoff``, with the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the row travels as one column, so that its own columns may have any names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), texts().alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])
    stay = packed.mapInArrow(_score_task(shared), schema).filter(F.col("score") >= cutoff)
    return stay.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from those with crc32(doc_id) mod 5 other than 0."""
    docs, rest = read(spark, sf_dir, "documents", "doc_id", "text"), crc_mod("doc_id", 5)
    model = train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), "quality", rest != 0)
    return quality_scores(docs, model).select(
        "doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )
