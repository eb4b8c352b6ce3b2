"""Mixing sources to target weights with a low-discrepancy source schedule.

1. Sizes are words.  Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share
   all words; a target stops at ``MAX_LAPS`` times its source's size and the excess is shared
   again by weight (only two sums of each round reach the driver, never the sources).
2. Each source's documents are put in a hashed order and laid end to end; a distributed prefix
   sum gives every document its first token, so a hot source spreads over all tasks.  Laps over
   that line are cut into blocks of equal tokens; a source gets as many blocks as its target
   needs, the last one filled in part.
3. The schedule: van der Corput points, mapped through the cumulative weights (in whole blocks),
   name the source of each slot.  Slots are ranked within their source in schedule order, and
   slot k of a source takes its block k.  All prefixes of the schedule are near the weights.
4. Joining blocks with the documents that lie in them gives what the mix takes of each one.

Null text has size 0, as has one without words; nothing is taken of either.  Repeated rows are
documents of their own.  Equal order hashes are ordered by doc_id.  With no words all targets
are 0.  An empty table gives an empty result.  Reruns agree: every order depends on the rows
alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.joins import bounded_broadcast
from ..functions.numbering import number_rows
from .common import WORD, read, ship, store

WEIGHTS = (1, 2, 3)
MAX_LAPS = 3
SEED = 11
#: Blocks are the larger the more there is to mix, up to this many words.
LARGEST_BLOCK = 4096
LEAST_SLOTS = 1 << 16
_SOURCE = ["_no_source", "_source"]


def words(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _running(schema: T.StructType, value: str, groups: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.zeros(batch.num_rows, bool)
            for g in groups:
                col = batch.column(g)
                change[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
            key = [batch.column(g)[0].as_py() for g in groups]
            change[0] = last is not None and key != last
            before = np.cumsum(sizes) - sizes
            starts = np.flatnonzero(change)
            base = np.zeros(batch.num_rows, np.int64)
            for n, at in enumerate(starts):
                base[at : starts[n + 1] if n + 1 < len(starts) else None] = -before[at]
            base[: starts[0] if len(starts) else None] = total
            before = before + base
            last, total = [batch.column(g)[batch.num_rows - 1].as_py() for g in groups], int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "_before"])

    return run


def running_sum(df: DataFrame, order: list[str], value: str, groups: list[str]) -> DataFrame:
    """``df`` with _before (sum of ``value`` over the earlier rows of the group) and _id (unique).

    Rows are range-partitioned, so a large group spreads over tasks; each partition's sums (one
    row for each partition and group in it) give the offsets.  Group columns must not be null.
    """
    tagged = (
        df.repartitionByRange(*groups, *order)
        .sortWithinPartitions(*groups, *order)
        .withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    )
    schema = T.StructType([*tagged.schema.fields, T.StructField("_before", T.LongType())])
    stored = store(tagged.mapInArrow(_running(schema, value, groups), schema), "running")
    sums = store(stored.groupBy("_part", *groups).agg(F.sum(value).alias("_sum")), "sums")
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *groups, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    size = sums.agg(F.count(F.lit(1)), F.sum(F.length("_source"))).first() if "_source" in groups else (sums.count(), 0)
    joined = stored.join(bounded_broadcast(offsets, size[0], size[1] or 0), ["_part", *groups])
    return joined.withColumn("_before", F.col("_before") + F.col("_offset")).drop("_part", "_offset")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, laps: int = MAX_LAPS) -> DataFrame:
    """_no_source, _source, source_size, target for the sources of ``sized`` (_size)."""
    sums = sized.groupBy(*_SOURCE).agg(F.sum("_size").alias("source_size"))
    ranked = number_rows(sums, _SOURCE, "_rank", id_type=T.LongType())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = store(ranked.withColumn("_weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, None
    while True:
        over = F.lit(share) * F.col("_weight") > laps * F.col("source_size") if full is not None else F.lit(False)
        row = ranked.agg(
            F.count(F.when(over, 1)),
            F.sum(F.when(over, laps * F.col("source_size"))),
            F.sum(F.when(~over, F.col("_weight"))),
        ).first()
        if full is not None and (row[0] == full or not row[2]):
            break
        full = row[0]
        share = (total - (row[1] or 0)) / row[2] if row[2] else 0.0
    target = F.least(F.col("_weight") * F.lit(share), (laps * F.col("source_size")).cast("double"))
    return ranked.select(*_SOURCE, "source_size", "_weight", target.alias("target"))


def block_words(total: int) -> int:
    return max(1, min(LARGEST_BLOCK, total // LEAST_SLOTS))


def schedule(sources: DataFrame, block: int, chunk: int = 1 << 15) -> DataFrame:
    """The slots: _no_source, _source, slot (place in the schedule), block (rank in its source).

    The cells of a power-of-two grid are dealt to the sources in order, as many as each has
    blocks (_blocks).  Slot j shows the van der Corput point bit-reverse(j); a point beyond the
    last source's cells is void.
    """
    sources = running_sum(sources.withColumn("_all", F.lit(0)), _SOURCE, "_blocks", ["_all"]).drop("_all")
    cells = sources.agg(F.sum("_blocks")).first()[0] or 0
    bits = max(1, int(cells - 1).bit_length()) if cells else 1
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1, F.lit(chunk).cast("long")))
    runs = sources.filter("_blocks > 0").select(*_SOURCE, "_before", "_blocks", firsts.alias("_first"))
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(n, *_SOURCE, "_first")
    last = F.least(F.col("_blocks"), F.col("_first") + chunk) - 1
    cell = F.explode(F.sequence(F.col("_before") + F.col("_first"), F.col("_before") + last))
    slots = runs.select(*_SOURCE, cell.alias("_cell"))
    point = F.conv(F.reverse(F.lpad(F.bin("_cell"), bits, "0")), 2, 10).cast("long")
    ranked = number_rows(slots.select(*_SOURCE, point.alias("slot")), ["slot"], "block", group_cols=_SOURCE)
    return ranked.withColumn("block", F.col("block") - 1)


def mix(docs: DataFrame, carry: list[str] | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, laps, slots) for ``docs`` with doc_id, text and source.

    rows: the columns ``carry`` (all) of ``docs`` as the struct _row, with _id, _size, source_size and target.
    laps: _id, _lap, taken: the words that the mix takes of a row in each lap, where any.
    slots: the schedule.
    """
    ship(docs.sparkSession)
    sized = docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("_row"),
        F.col("doc_id").cast("long").alias("_doc"),
        F.col("source").isNull().alias("_no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        words().alias("_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_order"),
    )
    lines = running_sum(sized, ["_order", "_doc"], "_size", _SOURCE)
    aims = store(targets(lines), "targets")
    count, width, total = aims.agg(F.count(F.lit(1)), F.sum(F.length("_source")), F.sum("source_size")).first()
    block = block_words(total or 0)
    aims = aims.withColumn("_take", F.round("target").cast("long"))
    slots = schedule(aims.select(*_SOURCE, F.ceil(F.col("_take") / block).alias("_blocks")), block)
    rows = lines.join(bounded_broadcast(aims, count, width or 0), _SOURCE)
    lap = F.explode(F.sequence(F.lit(0), F.lit(MAX_LAPS - 1)))
    first = F.col("_lap") * F.col("source_size") + F.col("_before")
    spans = (
        rows.filter("_size > 0")
        .select("_id", *_SOURCE, "_size", "_before", "source_size", "_take", lap.alias("_lap"))
        .withColumns({"_from": first, "_to": F.least(first + F.col("_size"), F.col("_take"))})
        .filter("_from < _to")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    )
    part = F.least(F.col("_to"), (F.col("block") + 1) * block) - F.greatest(F.col("_from"), F.col("block") * block)
    laps = spans.join(slots, [*_SOURCE, "block"]).groupBy("_id", "_lap").agg(F.sum(part).alias("taken"))
    return rows.select("_id", "_row", "_doc", "_size", "source_size", "target"), laps, slots


def taken(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken."""
    rows, laps, _ = mix(docs, carry=["doc_id"])
    sums = laps.groupBy("_id").agg(F.sum("taken").alias("taken"))
    return rows.join(sums, "_id", "left").select(
        F.col("_doc").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each lap that takes it.

    A row of which a lap takes only the first words (one in a source at most) has them joined by
    spaces; all others are whole.
    """
    rows, laps, _ = mix(docs)
    cut = F.array_join(F.slice(F.split(F.ltrim(F.regexp_replace("_row.text", r"[\x20\x09-\x0D]+", " ")), " "), 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < F.col("_size"), cut).otherwise(F.col("_row.text"))
    out = rows.join(laps, "_id")
    return out.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of each document."""
    return taken(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
