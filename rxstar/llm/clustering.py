"""Centroid clustering: Lloyd's rounds, sharded by dimension, in exact integers.

Vectors become integers floor(scale * x), and are cut into chunks of rows and column blocks; a
row of the stored table is one block of one chunk.  In each round

1. a task of a column block computes the exact partial distances of a chunk to its block's slice
   of every centroid (the slices have clusters x width numbers, which no data can enlarge);
2. the partial distances are shuffled by chunk and added up, and each vector takes the smallest
   sum (ties: the smaller number);
3. the block's rows ride along, so the same task adds them up by cluster; one row of each task and
   block goes to the block's shard, which divides (floor) and has its own new slice.

No shuffle has a hot key: chunks have a bounded number of rows, and sums are one row of each task.
Products are taken in double precision where all sums stay below 2^53, in 64-bit integers below
2^62, and else in Python's integers, so every figure is exact.

Vectors of another length than ``dims``, null ones and those with null or non-finite components are
left out.  Rows without vec_id are clustered, but start a centroid only if others are too few.
Repeated rows are vectors of their own; equal start hashes are told apart by the vector.  Fewer rows
than ``clusters`` start fewer centroids.  Distances and sums that a long cannot hold are null.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fixed_rows, read, runs, ship, store

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
BLOCKS = 4
CHUNK_ROWS = 2048
_LONG = 1 << 63


def pack(x: np.ndarray) -> bytes:
    """Integers as bytes: the narrowest type that holds them, or digits beyond 64 bits."""
    if x.dtype == object:
        return b"d" + json.dumps(x.tolist()).encode()
    most = int(np.abs(x).max()) if x.size else 0
    kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
    return (b"2" if kind == "int16" else b"4" if kind == "int32" else b"8") + x.astype(kind).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` integers: int64, or Python's integers."""
    if data[:1] == b"d":
        return np.array(json.loads(data[1:]), dtype=object).reshape(-1, width)
    kind = {b"2": np.int16, b"4": np.int32, b"8": np.int64}[data[:1]]
    return np.frombuffer(data, kind, offset=1).astype(np.int64).reshape(-1, width)


def most_of(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly."""
    if not x.size or np.abs(x).max() < 2.0**53:
        return np.floor(x * float(scale)).astype(np.int64)
    # doubles from 2^53 on are whole numbers
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in row] for row in x.tolist()], dtype=object)


def partial_distances(x: np.ndarray, c: np.ndarray, dims: int) -> np.ndarray:
    """(rows, clusters): squared distances over one block's columns; exact.

    ``dims``: columns of all blocks, so that the sum over the blocks stays exact too.
    """
    bound = dims * (most_of(x) + most_of(c)) ** 2
    if bound < 1 << 51:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return d.astype(np.int64)
    if bound < 1 << 62:
        return np.stack([((x.astype(np.int64) - row.astype(np.int64)) ** 2).sum(axis=1) for row in c], axis=1)
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def block_sums(x: np.ndarray, cluster: np.ndarray, clusters: int) -> np.ndarray:
    """(clusters, width): the sums of the rows of each cluster, as Python's integers."""
    kind = object if x.dtype == object or most_of(x) * max(len(x), 1) >= 1 << 62 else np.int64
    sums = np.zeros((clusters, x.shape[1]), kind)
    np.add.at(sums, cluster, x.astype(kind))
    return sums.astype(object)


def _edges(dims: int, blocks: int) -> list[int]:
    blocks = max(1, min(blocks, dims))
    return [round(dims * b / blocks) for b in range(blocks + 1)]


_CHUNK = "chunk long, block int, ids array<long>, data binary"


def _chunk(dims: int, edges: list[int], scale: int, rows: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in fixed_rows([batch], rows):
                vectors = part.column("vec")
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                whole = to_integers(x, scale)
                blocks = [pack(whole[:, a:b]) for a, b in zip(edges, edges[1:])]
                ids = [part.column("vec_id").to_pylist(), *[None] * len(blocks)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at] * len(ids), pa.int64()), pa.array(range(-1, len(blocks)), pa.int32()),
                        pa.array(ids, pa.list_(pa.int64())), pa.array([None, *blocks], pa.binary()),
                    ],
                    names=["chunk", "block", "ids", "data"],
                )
                at += 1

    return run


def _partial(centroids: np.ndarray, edges: list[int]) -> Callable:
    """Adds ``part``: the partial distances of a block's rows to its slice of each centroid."""
    dims = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fixed_rows(batches, 16):
            parts = []
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if block < 0:
                    parts.append(None)
                    continue
                a, b = edges[block], edges[block + 1]
                parts.append(pack(partial_distances(unpack(data, b - a), centroids[:, a:b], dims)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.binary())], names=[*batch.schema.names, "part"])

    return run


def _nearest(table: pa.Table, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and the distance of a chunk's rows: its blocks' partial distances added up."""
    total = None
    for data in table.column("part").to_pylist():
        if data is not None:
            d = unpack(data, clusters)
            total = d if total is None else total + d
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(clusters: int, edges: list[int]) -> Callable:
    """One row for each block: the sums and counts of the clusters over all chunks of the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count = np.zeros(clusters, np.int64)
        for table in runs(batches, ["chunk"]):
            cluster, _ = _nearest(table, clusters)
            count += np.bincount(cluster, minlength=clusters)
            for block, data in zip(table.column("block").to_pylist(), table.column("data").to_pylist()):
                own = block_sums(unpack(data, edges[block + 1] - edges[block]), cluster, clusters)
                sums[block] = own if block not in sums else sums[block] + own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([pack(s) for s in sums.values()], pa.binary()), pa.array([pack(count[:, None])] * len(sums), pa.binary())],
                names=["block", "sums", "counts"],
            )

    return run


def _shard(centroids: np.ndarray, edges: list[int]) -> Callable:
    """The new slice of each block: the floor of the mean; empty clusters keep theirs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data, n in zip(*(batch.column(c).to_pylist() for c in ("block", "sums", "counts"))):
                own, n = unpack(data, edges[block + 1] - edges[block]).astype(object), unpack(n, 1)[:, 0]
                sums[block] = own if block not in sums else sums[block] + own
                counts[block] = n if block not in counts else counts[block] + n
        for block, total in sums.items():
            n = counts[block].astype(object)
            mean = total // np.where(n > 0, n, 1)[:, None]
            new = np.where((n > 0)[:, None], mean, centroids[:, edges[block] : edges[block + 1]].astype(object))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(new)], pa.binary())], names=["block", "slice"])

    return run


def _assign(clusters: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["chunk"]):
            cluster, distance = _nearest(table, clusters)
            ids = next(v for v in table.column("ids").to_pylist() if v is not None)
            far = [int(d) if d < _LONG else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"]
            )

    return run


def narrow(x: np.ndarray) -> np.ndarray:
    """Python's integers as int64 where they fit."""
    return x.astype(np.int64) if x.dtype == object and most_of(x) < 1 << 62 else x


def usable(vec: Column, dims: int) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) == dims) & ~bad, F.lit(False))


def lloyd(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
    blocks: int = BLOCKS,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable row of ``vectors`` (vec_id, embedding), and the final centroids.

    Centroids start as the vectors with the smallest SHA-256 of ``seed:vec_id``.
    """
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    kept = kept.filter(usable(F.col("vec"), dims))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "vec").limit(clusters).select("vec").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    centroids = to_integers(np.array([r["vec"] for r in first], np.float64), scale)
    k, edges = len(centroids), _edges(dims, blocks)
    table = store(kept.mapInArrow(_chunk(dims, edges, scale, chunk_rows), _CHUNK), "vector-blocks")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        parts = table.filter("block >= 0").select("chunk", "block", "data")
        parts = parts.mapInArrow(_partial(centroids, edges), "chunk long, block int, data binary, part binary")
        dealt = parts.repartition(n, "chunk").sortWithinPartitions("chunk", "block")
        sums = dealt.mapInArrow(_sums(k, edges), "block int, sums binary, counts binary")
        slices = sums.repartition(len(edges) - 1, "block").mapInArrow(_shard(centroids, edges), "block int, slice binary")
        new = centroids.astype(object)
        for block, data in slices.collect():  # clusters x dims numbers
            new[:, edges[block] : edges[block + 1]] = unpack(data, edges[block + 1] - edges[block])
        centroids = narrow(new)
    parts = table.mapInArrow(_partial(centroids, edges), _CHUNK + ", part binary").select("chunk", "block", "ids", "part")
    dealt = parts.repartition(n, "chunk").sortWithinPartitions("chunk", "block")
    return store(dealt.mapInArrow(_assign(k), "vec_id long, cluster int, distance long"), "clusters"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after five rounds, with inertias and the final centroids' digests."""
    rows, centroids = lloyd(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    far = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(far, F.count(F.lit(1)) == F.count("distance")).collect()  # a row for each cluster
    of = {r[0]: int(r[1]) if r[2] else _LONG for r in sums}
    whole = sum(of.values()) if all(d < _LONG for d in of.values()) else _LONG
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    figures = [(i, d if d < _LONG else None, whole if whole < _LONG else None, digest[i]) for i, d in of.items()]
    figures = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, embedding) AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS c
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND list_count(embedding) = {DIMS}
    AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}
), x AS MATERIALIZED (
  SELECT r, unnest(c) AS v, generate_subscripts(c, 1) AS dim FROM kept
), c0 AS MATERIALIZED (
  SELECT r - 1 AS k, dim, v FROM x WHERE r <= {CLUSTERS}
)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT r, k, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{i} c USING (dim) GROUP BY r, k) GROUP BY r
)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT k, dim, coalesce(m, v) AS v
  FROM c{i} LEFT JOIN (
    SELECT k, dim, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
    FROM (SELECT k, dim, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY k, dim)
  ) USING (k, dim)
)"""
            )
    last = f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r)
JOIN (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY dim)) AS sha FROM c{ROUNDS} GROUP BY k) USING (k)
"""
    return ",\n".join(steps) + last


OP11_SQL = _sql()
