"""Toxicity: compression-distance classification with zstandard dictionaries.

Two dictionaries are trained: one on ordinary text, one on toxic text.  What a toxic document
says is mostly ordinary, so the toxic dictionary's samples are the passages that set toxic
documents apart: the longest beginnings of words that are significantly more frequent (by
documents; log-likelihood against the log of the number of beginnings) in toxic texts.  Both
compressors hold the ordinary dictionary; the toxic one holds the toxic dictionary after it (nearest to the text, so
matches in it are the cheapest).

A text is cut into windows of ``WIDTH`` words.  For each window the distance is the compressed
length without, less that with the toxic dictionary.  The largest distances and the shares of
windows over fixed distances are the input of a logistic calibration, fitted on the sample with
weights that restore the classes' shares.

The sample is bounded (``labelled.MAX_OF_CLASS`` rows of each class) and its texts are used whole.
Beginnings are counted and features computed in tasks of their own; single tasks get the counts
of the toxic texts' beginnings, the features, and the ordinary texts' windows (zstandard's trainer
needs them at once: in memory, all that the sample's ordinary rows hold).  Scoring covers all
windows of all texts.  Null text
counts as empty; a text without words is one empty window.  Repeated rows score alike.  Without
labels of both classes the score is the share of label 1 (0.5 without any).  An empty table gives
an empty result; extra columns are passed over.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, fixed_rows, read, ship, store, texts
from .labelled import training_sample

WIDTH = 10
SHORTEST, LONGEST = 4, 12
SIGNIFICANCE = 2.0
RATIO = 5.0
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 4 << 10
LEVEL = 3
CUTOFF = 0.3
N_FEATURES = 8


def windows(text: bytes, width: int = WIDTH) -> list[bytes]:
    """The lower-cased words of a text (A-Z), in runs of ``width``, each with a space around."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(0, max(1, len(words)), width)]


def beginnings(word: bytes) -> list[bytes]:
    """The word's beginnings of 4 to 12 bytes, with the space before it."""
    return [b" " + word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)]


def _log_likelihood(a: int, b: int, n1: int, n0: int) -> float:
    def of(k: int, n: int, p: float) -> float:
        return (k * log(p) if k else 0.0) + ((n - k) * log(1 - p) if n > k else 0.0)

    p = (a + b) / (n1 + n0)
    return 2 * (of(a, n1, a / n1) + of(b, n0, b / n0) - of(a, n1, p) - of(b, n0, p)) if 0 < p < 1 else 0.0


def beginnings_of(text: bytes) -> set[bytes]:
    """The different beginnings of a text's words."""
    return {g for w in set(text.lower().split()) for g in beginnings(w)}


def telling(seen: Iterable[tuple[bytes, int, int]], n1: int, n0: int, kinds: int) -> dict[bytes, float]:
    """The beginnings that toxic documents have significantly more often.

    ``seen``: beginning, toxic and ordinary documents that hold it; ``n1`` and ``n0``: all such
    documents; ``kinds``: the beginnings of toxic and those of ordinary documents.
    """
    least = SIGNIFICANCE * log(max(kinds, 2))
    often = {g: _log_likelihood(a, b, n1, n0) for g, a, b in seen if a / n1 > RATIO * b / n0}
    return {g: x for g, x in often.items() if x > least}


def toxic_dictionary(kept: dict[bytes, float], size: int) -> bytes:
    """The telling passages, the most significant ones last (nearest to the text), each once."""
    out: list[bytes] = []
    for g in sorted(kept, key=lambda g: (-kept[g], -len(g), g)):
        if not any(g in o for o in out) and sum(map(len, out)) + len(g) <= size:
            out.append(g)
    return b"".join(reversed(out))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None
    _tools: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def tools(self) -> tuple:
        if self._tools is None:
            self._tools = tuple(
                zstandard.ZstdCompressor(
                    level=LEVEL,
                    dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                    write_checksum=False, write_content_size=False, write_dict_id=False,
                ).compress
                for d in (self.ordinary, self.ordinary + self.toxic)
            )
        return self._tools

    def features(self, text: bytes) -> np.ndarray:
        plain, toxic = self.tools()
        d = np.sort(np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float))[::-1]
        return np.array([d[0], d[:3].mean(), d.mean(), *((d >= k).mean() for k in (2, 3, 5)), *(np.log1p((d >= k).sum()) for k in (2, 4))])

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        z = np.append((self.features(text) - self.mean) / self.scale, 1.0) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _constant(weights: dict[int, float]) -> Model:
    """The share of label 1, from the weight of each label."""
    zero = np.zeros(N_FEATURES)
    share = weights.get(1, 0.0) / sum(weights.values()) if weights else 0.5
    return Model(b"", b"", np.zeros(N_FEATURES + 1), zero, zero + 1, share)


def _samples(texts: Iterable[bytes], width: int) -> list[bytes]:
    return sorted((w for t in texts for w in windows(t, width)), key=lambda w: (zlib.crc32(w), w))


def _calibration(rows: list[tuple[list[float], int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights from (features, label, weight)."""
    rows = sorted(rows)
    x = np.array([r[0] for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    return mean, scale, _logistic((x - mean) / scale, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows]))


def for_words(text: bytes) -> bool:
    """Whether a training text gives the dictionaries (two thirds) or the calibration."""
    return zlib.crc32(text) % 3 < 2


def fit(rows: list[tuple[bytes, int, float]]) -> Model:
    """Train on (text, label, weight); the result depends on the rows, not their order.

    Equal texts count once (copies are no further evidence).  Two thirds of the rows give the
    dictionaries and the rest the calibration, so that it is honest; then the toxic dictionary
    is made anew from all rows.
    """
    rows = sorted({r[0]: r for r in sorted(rows, reverse=True)}.values())
    if len({r[1] for r in rows}) < 2:
        return _constant({y: sum(r[2] for r in rows if r[1] == y) for y in {r[1] for r in rows}})

    def part(first: bool) -> list[tuple[bytes, int, float]]:
        some = [r for r in rows if for_words(r[0]) == first]
        return some if len({r[1] for r in some}) == 2 else rows

    def toxic_of(some: list[tuple[bytes, int, float]]) -> bytes:
        seen = [Counter(), Counter()]
        for r in some:
            seen[r[1]].update(beginnings_of(r[0]))
        n1 = sum(r[1] for r in some)
        kept = telling([(g, a, seen[0][g]) for g, a in seen[1].items()], n1, len(some) - n1, len(seen[0]) + len(seen[1]))
        return toxic_dictionary(kept, TOXIC_BYTES) if kept else dictionary(_samples((r[0] for r in some if r[1]), WIDTH), TOXIC_BYTES)

    zero = np.zeros(N_FEATURES)
    plain = _samples((r[0] for r in part(True) if not r[1]), 24)
    model = Model(dictionary(plain, ORDINARY_BYTES), toxic_of(part(True)), np.zeros(N_FEATURES + 1), zero, zero + 1)
    model.mean, model.scale, model.weights = _calibration([(model.features(t).tolist(), y, w) for t, y, w in part(False)])
    model.toxic, model._tools = toxic_of(rows), None
    return model


def _one(df: DataFrame, make: Callable) -> object:
    """``make(columns)`` of all rows of a bounded table, in one task; only its result reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(rows))], pa.binary())], names=["made"])

    row = df.repartition(1).mapInArrow(run, "made binary").first()
    return pickle.loads(row[0]) if row else make([])


def _beginnings_task() -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(beginnings_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([y] * len(found), pa.int32())], names=["gram", "y"])

    return run


def _toxic_of(some: DataFrame, n1: int, n0: int) -> bytes:
    seen = some.select("text", "y").mapInArrow(_beginnings_task(), "gram binary, y int")
    seen = store(seen.groupBy("gram").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")), "beginnings")
    kinds = seen.agg(F.coalesce(F.sum((F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int")), F.lit(0))).first()[0]

    def make(rows: list[tuple]) -> bytes | None:
        kept = telling(rows, n1, n0, kinds)
        return toxic_dictionary(kept, TOXIC_BYTES) if kept else None

    made = _one(seen.filter(F.col("a") / n1 > RATIO * F.col("b") / n0), make)
    return made if made is not None else _one(some.filter("y = 1").select("text"), lambda rows: dictionary(_samples((r[0] for r in rows), WIDTH), TOXIC_BYTES))


def _features_task(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), *batch.columns[1:]], names=["features", "y", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str, rows) -> Model:
    """``fit`` over the sample's whole texts in Spark tasks; only the model (under 100 kB) reaches the driver."""
    ship(docs.sparkSession)
    sample = training_sample(docs, labels, label, rows).groupBy(F.sha2("text", 256).alias("hash"))
    sample = sample.agg(F.min(F.struct("y", "weight", "text")).alias("r")).select("r.text", "r.y", "r.weight")
    sample = store(sample.withColumn("words", F.crc32("text") % 3 < 2), "toxicity-sample")
    sums = sample.groupBy("words", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()
    if len({r["y"] for r in sums}) < 2:
        return _constant({y: sum(r["weight"] for r in sums if r["y"] == y) for y in {r["y"] for r in sums}})

    def number(some: list) -> tuple[int, int]:
        return tuple(sum(r["n"] for r in some if r["y"] == y) for y in (1, 0))

    def part(first: bool) -> tuple[DataFrame, tuple[int, int]]:
        n = number([r for r in sums if r["words"] == first])
        return (sample.filter(F.col("words") == first), n) if all(n) else (sample, number(sums))

    zero = np.zeros(N_FEATURES)
    some, n = part(True)
    plain = _one(some.filter("y = 0").select("text"), lambda found: dictionary(_samples((r[0] for r in found), 24), ORDINARY_BYTES))
    model = Model(plain, _toxic_of(some, *n), np.zeros(N_FEATURES + 1), zero, zero + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    features = part(False)[0].select("text", "y", "weight").mapInArrow(_features_task(shared), "features array<double>, y int, weight double")
    model.mean, model.scale, model.weights = _one(features, _calibration)
    model.toxic, model._tools = _toxic_of(sample, *number(sums)), None
    return model


def _score_task(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in fixed_rows(batches, 1024):
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"))
    return rows.mapInArrow(_score_task(shared), "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from those with crc32(doc_id) mod 4 other than 2."""
    docs, rest = read(spark, sf_dir, "documents", "doc_id", "text"), crc_mod("doc_id", 4)
    model = train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", rest != 2)
    return toxicity_scores(docs, model).select(
        "doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )
