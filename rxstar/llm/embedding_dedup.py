"""Embedding near-deduplication.

Random-hyperplane sign hashing in several tables finds candidates, cosine in double precision
verifies each, and distributed connected components group the links.

- Equal vectors are one row with a weight from the start (map-side combined), so copies are
  never compared or expanded.
- ``plan_tables`` sets bits and tables from the number of different vectors and the wanted
  recall at the threshold: the bits grow with its logarithm, so the mean bucket stays bounded,
  and the tables grow so that a pair at the threshold is missed with probability 1 - recall.
- Large buckets are cut into units of two chunks; no task gathers a bucket.
- A pair is counted in the first table that brings it together (each row carries its bits of
  all tables), so link counts are exact without listing pairs.  A unit emits for each row its
  count of links and one forest edge: output is linear in its rows.
- Vectors are shuffled in the type they are stored in (4 bytes a component for floats); every
  product is taken in double precision.

Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor
do vectors of different lengths.  Rows without vec_id cannot name a component: they link with
nothing and are not kept.  Repeated rows are other vectors; rows of one vec_id with different
vectors each have their own links and component.  A cosine that just reaches the threshold links.  Long
vectors are whole.  An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.joins import bounded_broadcast
from .blocks import forest, units
from .common import fixed_rows, read, runs, ship, store
from .components import components

THRESHOLD = 0.9
RECALL = 0.999
MEAN_BUCKET = 96
CAP = 1024
SEED = 7
_UNIT = ["dim", "tab", "key", "_i", "_j"]


def plan_tables(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, tables) for so many different vectors."""
    bits = min(30, max(3, ceil(log2(max(rows, 1) / MEAN_BUCKET)))) if rows > MEAN_BUCKET else 3
    hit = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - hit))


def signs(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) int32: the side of each table's hyperplanes that each vector lies on."""
    normal = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    side = (x @ normal > 0).reshape(len(x), tables, bits)
    return (side * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _hash(bits: int, tables: int, seed: int, stored: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fixed_rows(batches, 2048):
            reps, weights = (batch.column(c).to_numpy() for c in ("rep", "weight"))
            vectors = batch.column("vec")
            dims = vectors.value_lengths().to_numpy()
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
                keys = signs(x, bits, tables, seed)
                own, vec = [k.tobytes() for k in keys], [v.tobytes() for v in x.astype(stored)]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reps[at]), pa.array(weights[at]), pa.array(np.full(len(at), dim, np.int32)),
                            pa.array(np.full(len(at), t, np.int32)), pa.array(keys[:, t]),
                            pa.array(own, pa.binary()), pa.array(vec, pa.binary()),
                        ],
                        names=["rep", "weight", "dim", "tab", "key", "signs", "vec"],
                    )

    return run


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """(rows of a, rows of b) boolean: cosine at or above the threshold."""
    # scaling by the largest component keeps squares finite and changes no cosine
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    na, nb = (np.sqrt((x * x).sum(axis=1)) for x in (a, b))
    return (a @ b.T) / (na[:, None] * nb[None, :]) >= threshold


def _links(threshold: float, stored: str, slice_rows: int = 100_000) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _UNIT):
            ids, weights, tab, i, j, side = (
                table.column(c).to_numpy() for c in ("rep", "weight", "tab", "_i", "_j", "_side")
            )
            if len(ids) < 2:
                continue
            x = np.stack([np.frombuffer(v, stored) for v in table.column("vec").to_pylist()]).astype(np.float64)
            own = np.stack([np.frombuffer(s, np.int32) for s in table.column("signs").to_pylist()])[:, : tab[0]]
            if i[0] == j[0]:
                a, b = np.nonzero(np.triu(linked(x, x, threshold), 1))
            else:
                one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(one) or not len(two):
                    continue
                a, b = np.nonzero(linked(x[one], x[two], threshold))
                a, b = one[a], two[b]
            if not len(a):
                continue
            count = np.zeros(len(ids), np.int64)
            for at in range(0, len(a), slice_rows):  # pairs that no earlier table has brought together
                p, q = a[at : at + slice_rows], b[at : at + slice_rows]
                new = ~(own[p] == own[q]).any(axis=1)
                np.add.at(count, p[new], weights[q[new]])
                np.add.at(count, q[new], weights[p[new]])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            root = np.empty(len(ids), np.int64)
            root[order] = ids[order][forest(len(ids), rank[a], rank[b])]
            some = (count > 0) | (root != ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(root[some]), pa.array(count[some])], names=["u", "v", "links"]
            )

    return run


def usable(vec: Column) -> Column:
    """Vectors that can have a cosine: finite, not zero, nothing null."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


def embedding_dedup(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    ship(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType
    stored, kind = ("float32", "float") if getattr(kind, "elementType", None) == T.FloatType() else ("float64", "double")
    # + 0.0 makes the two zeros one
    vec = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(usable(F.col("vec")), F.lit(False)) & F.col("vec_id").isNotNull())
    good = rows.filter("ok").select("vec_id", "vec")
    # a class is known by a number of its own: rows of one vec_id may hold different vectors
    classes = good.groupBy("vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    classes = store(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    bits, tables = plan_tables(classes.count(), threshold, recall)
    hashed = classes.select("rep", "weight", "vec").mapInArrow(
        _hash(bits, tables, seed, stored),
        "rep long, weight long, dim int, tab int, key int, signs binary, vec binary",
    )
    dealt = units(hashed, ["dim", "tab", "key"], "rep", cap)
    found = store(dealt.mapInArrow(_links(threshold, stored), "u long, v long, links long"), "vector-links")
    reached = components(found.select("u", "v"))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    named = classes.join(reached, F.col("rep") == F.col("vertex")).select("rep", "low", "component")
    lowest = named.groupBy("component").agg(F.min("low").alias("lowest"))  # map-side combined
    named = named.join(bounded_broadcast(lowest, lowest.count()), "component").select(F.col("rep").alias("vertex"), "lowest")
    whole = (
        classes.join(counts, F.col("rep") == F.col("u"), "left")
        .join(named, F.col("rep") == F.col("vertex"), "left")
        .select(
            F.col("vec").alias("_vec"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links"),
            F.coalesce("lowest", "low").alias("_component"),
        )
    )
    # rows alone in their class and without links need no join
    return rows.join(whole.filter("_links > 0"), F.col("ok") & (F.col("vec") == F.col("_vec")), "left").select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(False)).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 among all embeddings, and their components."""
    return embedding_dedup(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
