"""SimHash near-deduplication with bit-sliced comparison.

Fingerprint: each shingle's XXH64 votes on 64 bits.  Equal fingerprints are one row from then
on.  Two fingerprints that differ in at most r bits agree on at least one way of choosing
``blocks - r`` of ``blocks`` equal parts of the 64 bits, so bucketing by every such choice loses
no link (``tables_for`` takes more, finer parts as the number of fingerprints grows; every
choice is exact).

Buckets are compared in blocks: the fingerprints of a block are stored as 64 vertical bit
planes, a lane for each.  For a query, plane after plane is XORed with the query's bit and added
to carry-save counters (three bit planes and an overflow), which updates 64 distances with one
machine word.  Queries whose lanes all exceed the radius are abandoned.  A block emits a
spanning forest of its links, at most one for each row, and never its pairs.

Null text counts as empty; a text without words has the fingerprint zero and links like any
other.  Fingerprints are the vertices, so a repeated or null doc_id links nothing.  A component is
named by its smallest doc_id and keeps the rows of that id's smallest fingerprint (without any id:
of its smallest one).  Repeated rows have one fingerprint.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.joins import bounded_broadcast
from .blocks import forest, units
from .common import fixed_rows, read, runs, ship, store, texts
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Rows of a chunk; the largest unit has two of them.
CAP = 1024
#: Mean bucket that a choice of tables should stay under.
MEAN_BUCKET = 64
#: Planes added between two looks at which queries can be abandoned.
STEP = 8


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words of the lower-cased text (all words if fewer)."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if over half of the hashes have it; 0 for a text without words."""
    hashes = shingle_hashes(text, size, seed)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # at most 255 votes fit a byte
        bits = np.unpackbits(hashes[at : at + 255].astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(size: int, seed: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fixed_rows(batches, 1024):
            marks = [fingerprint(t, size, seed) for t in batch.column(1).to_pylist()]
            marks = np.array(marks, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, text_hash: Column | None = None) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every row's whole text, as a signed 64-bit number."""
    ship(docs.sparkSession)
    hashed = F.lit("") if text_hash is None else text_hash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts().alias("text"), hashed.alias("text_hash"))
    return rows.mapInArrow(_fingerprints(size, seed), "doc_id long, fp long, text_hash string")


def tables_for(rows: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree on at least one of them.

    The 64 bits are cut into parts; a mask is a choice of parts that may be free of differing
    bits.  The number of parts is the smallest whose masks leave small buckets.
    """
    for parts in range(radius + 1, radius + 5):
        edges = [64 * i // parts for i in range(parts + 1)]
        part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(part, parts - radius)]
        if rows >> min(m.bit_count() for m in masks) <= MEAN_BUCKET:
            break
    assert len(masks) == comb(parts, radius)
    return masks


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane p is bit p of fingerprint i."""
    lanes = -len(fps) % 64
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8)).reshape(-1, 64).T  # plane 0: highest bit
    bits = np.pad(bits, ((0, 0), (0, lanes)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, lane) of fingerprints within the radius, by bit-sliced distances."""
    if radius > 6:
        raise ValueError("three counter planes hold a radius of 6 at most")
    planes, words = planes_of(fps), -(-len(fps) // 64)
    flip = np.unpackbits(queries.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.uint64) * ~np.uint64(0)
    alive = np.arange(len(queries))
    ones, twos, fours, over = (np.zeros((len(queries), words), np.uint64) for _ in range(4))
    if words and len(fps) % 64:  # lanes that hold nothing exceed every radius
        over[:, -1] = ~np.uint64((1 << (len(fps) % 64)) - 1)
    for p in range(64):
        x = planes[p] ^ flip[alive, p][:, None]
        carry = ones & x
        ones ^= x
        x = twos & carry
        twos ^= carry
        over |= fours & x
        fours ^= x
        if p % STEP == STEP - 1:
            far = over | _above(ones, twos, fours, radius)
            going = (far != ~np.uint64(0)).any(axis=1)
            if not going.all():
                alive = alive[going]
                ones, twos, fours, over = ones[going], twos[going], fours[going], over[going]
                if not len(alive):
                    break
    near = ~(over | _above(ones, twos, fours, radius))
    bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")
    q, lane = np.nonzero(bits)
    return alive[q], lane


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is above the radius."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def _links(radius: int, cap: int) -> Callable:
    def blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(identifiers, fingerprints, side) to compare; None: all with all."""
        ids, fps = (table.column(c).to_numpy() for c in ("rep", "fp"))
        i, j, side = (table.column(c).to_numpy() for c in ("_i", "_j", "_side"))
        pair = i != j
        if not pair.any():
            yield ids, fps.view(np.uint64), None
            return
        key = np.stack([table.column(c).to_numpy() for c in ("tab", "key", "_i", "_j")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for at in np.split(np.arange(len(ids)), cuts):
            yield ids[at], fps[at].view(np.uint64), side[at] if pair[at[0]] else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["tab", "key", "_i", "_j"], least=cap // 2):
            for ids, fps, side in blocks(table.combine_chunks()):
                if side is None:
                    a, b = close_pairs(fps, fps, radius)
                else:
                    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    a, b = close_pairs(fps[one], fps[two], radius)
                    a, b = one[a], two[b]
                order = np.argsort(ids, kind="stable")  # the root is the smallest identifier
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                root = ids[order][forest(len(ids), rank[a], rank[b])]
                linked = root != ids[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[order][linked]), pa.array(root[linked])], names=["u", "v"]
                )

    return run


def fingerprint_groups(marks: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(fp, component_id, head) for every fingerprint of ``marks`` (doc_id, fp).

    component_id is the smallest doc_id that links of at most ``radius`` bits reach, head the
    fingerprint whose rows of that doc_id are kept.
    """
    classes = store(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    masks = tables_for(classes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = classes.select(
        F.col("fp").alias("rep"), "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("tab", "key")
    )
    links = units(keyed, ["tab", "key"], "fp", cap).mapInArrow(_links(radius, cap), "u long, v long")
    reached = components(links)
    # only linked fingerprints have a head to be found, map-side combined; all others are their own
    linked = classes.join(reached, F.col("fp") == F.col("vertex")).select("fp", "low", "component")
    heads = linked.groupBy("component").agg(F.min(F.struct(F.col("low").isNull(), "low", "fp")).alias("h"))
    linked = linked.join(bounded_broadcast(heads, heads.count()), "component").select(F.col("fp").alias("vertex"), "h")
    joined = classes.join(linked, F.col("fp") == F.col("vertex"), "left")
    own = F.col("vertex").isNull()
    return joined.select(
        "fp", F.when(own, F.col("low")).otherwise(F.col("h.low")).alias("component_id"), F.coalesce("h.fp", "fp").alias("head")
    )


def simhash_dedup(
    docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, cap: int = CAP
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp, fingerprint (hex), component_id, kept."""
    marks = store(fingerprints(docs, size, seed), "simhash")
    out = marks.join(fingerprint_groups(marks, radius, cap), "fp", "left")
    return out.select(
        "doc_id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("head"))).alias("kept"),
    )


def kept_rows(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that ``simhash_dedup`` keeps, with the same columns.

    A row is known by its doc_id and the hash of its text.  Rows without a doc_id stay where their
    component has one; where it has none, those of one fingerprint stay.
    """
    text = F.sha2(texts(), 256)
    marks = store(fingerprints(docs, size, SEED, text), "simhash")
    groups = fingerprint_groups(marks, radius)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("head"))
    gone = marks.join(groups, "fp").filter(~kept & (F.col("doc_id").isNotNull() | F.col("component_id").isNull())).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct()
    # the row travels as one column, so that its own columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text.alias("_hash"))
    stay = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_text")), "left_anti")
    return stay.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints of 4-word shingles link at 4 bits or fewer."""
    out = simhash_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "fingerprint", "component_id", "kept")
