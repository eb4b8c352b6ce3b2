"""Exact deduplication: Patricia-trie owners.

Rows are partitioned by length class and some bits of a content hash, and whole byte strings go into
a radix trie for each partition, which shares what they begin with; terminal nodes hold the owner (the identifier that stays), the
number of rows, and how many of them carry the owner's identifier.

1. Each scan task inserts its own rows first and passes on one row for each different text, so
   a text that a third of all rows repeat is one row for each task before the shuffle.
2. The partial rows are shuffled by (length class, hash) and sorted by these and the text.  A task
   then sees the partitions one after another and frees each trie once its strings are over.

Spill is by subtree: over ``budget`` bytes, step 1 emits the largest subtrees and forgets them
(a text met again is one more partial row), step 2 emits the strings that sort before the
current one (they cannot come again).  No task holds more than the budget and one text.

Null text counts as empty.  ``owner`` is the smallest or largest identifier; null identifiers
lose against any other.  Repeated rows (same identifier and text) count one by one, and one of
them is kept.  Long texts are whole.  An empty table gives an empty result; other columns, whatever
their names, are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.joins import bounded_broadcast
from .common import read, ship, store
from .trie import Trie

#: A trie holds the texts of one length class (of so many bytes) and of one value of the hash's low bits.
CLASS_BYTES = 64
HASH_BITS = 4
BUDGET = 96 << 20
_PARTIAL = "_class long, _hash long, _text binary, _sha string, _owner long, _rows long, _of_owner long"
_GROUP = "_len long, _sha string, _owner long, _rows long, _of_owner long"


def merge(owner: list | None, ident: int | None, rows: int, of_owner: int, sha: str, largest: bool) -> list:
    """The owner record [sha, identifier, rows, rows with that identifier] after more rows."""
    if owner is None:
        return [sha, ident, rows, of_owner]
    owner[2] += rows
    if ident == owner[1]:
        owner[3] += of_owner
    elif owner[1] is None or (ident is not None and (ident > owner[1] if largest else ident < owner[1])):
        owner[1], owner[3] = ident, of_owner
    return owner


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _partial(largest: bool, budget: int) -> Callable:
    schema = pa.schema([("_class", pa.int64()), ("_hash", pa.int64()), ("_text", pa.binary()), ("_sha", pa.string()),
                        ("_owner", pa.int64()), ("_rows", pa.int64()), ("_of_owner", pa.int64())])

    def emit(tries: dict, wanted: list) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for key in wanted:
            for text, o in tries.pop(key).items():
                out.append((*key, text, *o))
                size += len(text)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, int], Trie] = {}
        held = 0
        for batch in batches:
            for ident, text, sha, h in _rows(batch):
                trie = tries.setdefault((len(text) // CLASS_BYTES, h), Trie())
                before = trie.held
                node = trie.node(text)
                node.owner = merge(node.owner, ident, 1, 1, sha, largest)
                held += trie.held - before
                if held > budget:
                    by_size = sorted(tries, key=lambda k: -tries[k].held)
                    gone = []
                    while by_size and held > budget // 2:
                        gone.append(by_size.pop(0))
                        held -= tries[gone[-1]].held
                    yield from emit(tries, gone)
        yield from emit(tries, list(tries))

    return run


def _final(largest: bool, budget: int) -> Callable:
    schema = pa.schema([("_len", pa.int64()), ("_sha", pa.string()), ("_owner", pa.int64()), ("_rows", pa.int64()),
                        ("_of_owner", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Trie(), None
        for batch in batches:
            out = []

            def flush() -> None:
                out.extend((len(t), *o) for t, o in trie.items() if o[2] > 1)

            for of_class, h, text, sha, ident, rows, of_owner in _rows(batch):
                if last is not None and (of_class, h) != last:  # the partition is over: its trie goes
                    flush()
                    trie = Trie()
                elif trie.held > budget:  # sorted: all but the text at hand are over
                    same = trie.node(text).owner
                    trie.node(text).owner = None
                    flush()
                    trie = Trie()
                    trie.node(text).owner = same
                node = trie.node(text)
                node.owner = merge(node.owner, ident, rows, of_owner, sha, largest)
                last = (of_class, h)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        out = [(len(t), *o) for t, o in trie.items() if o[2] > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def text_owners(docs: DataFrame, keep: str = "largest", budget: int = BUDGET, hash_bits: int | None = None) -> DataFrame:
    """Texts of more than one row: _len, _sha (SHA-256), _owner, _rows, _of_owner.

    The hash has as many bits more as the session has shuffle partitions, so that these are filled.
    """
    if hash_bits is None:
        hash_bits = HASH_BITS + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_owner"),
        text.cast("binary").alias("_text"),
        F.sha2(text.cast("binary"), 256).alias("_sha"),
        F.xxhash64(text).bitwiseAND((1 << hash_bits) - 1).alias("_hash"),
    )
    partial = rows.mapInArrow(_partial(keep == "largest", budget), _PARTIAL)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.repartition(n, "_class", "_hash").sortWithinPartitions("_class", "_hash", "_text")
    return store(dealt.mapInArrow(_final(keep == "largest", budget), _GROUP), "owners")


def _judged(docs: DataFrame, carry: list[str], keep: str) -> DataFrame:
    """_row (the columns ``carry``), doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(True).alias("_"))
    keyed = docs.select(
        row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("_len"), F.sha2(text, 256).alias("_sha")
    )
    owners = text_owners(docs, keep)
    n, width, most = owners.agg(F.count(F.lit(1)), F.sum(F.length("_sha")), F.max("_of_owner")).first()
    # only texts of several rows are here; within a checked bound they are broadcast, so that the
    # texts of documents are not shuffled again
    joined = keyed.join(bounded_broadcast(owners, n, width or 0), ["_len", "_sha"], "left")
    whole = joined.select(
        "_row",
        "doc_id",
        F.when(F.col("_rows").isNull(), F.col("doc_id")).otherwise(F.col("_owner")).alias("keep_id"),
        F.coalesce("_rows", F.lit(1)).alias("group_size"),
        (F.col("_rows").isNull() | F.col("doc_id").eqNullSafe(F.col("_owner"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.coalesce("_of_owner", F.lit(1)).alias("_of_owner"),
    )
    if (most or 1) <= 1:  # no owner's row is repeated
        return whole.drop("_of_owner")
    # Repeated rows of an owner: the one with the smallest number stays.  Numbers are stored, so that
    # they are the same whenever they are read; they are joined by the number, which is no hot key.
    several = F.col("kept") & (F.col("_of_owner") > 1)
    repeats = store(whole.filter(several).withColumn("_number", F.monotonically_increasing_id()), "repeats")
    first = repeats.groupBy("doc_id", "text_sha256").agg(F.min("_number").alias("_number")).select("_number", F.lit(True).alias("_first"))
    decided = repeats.join(first, "_number", "left").withColumn("kept", F.coalesce("_first", F.lit(False)))
    return whole.filter(~several).unionByName(decided.select(whole.columns)).drop("_of_owner")


_GIVEN = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    ``docs`` needs doc_id and text; its other columns are passed on.  Columns that already have
    one of the four names are replaced.
    """
    carry = [c for c in docs.columns if c not in _GIVEN]
    return _judged(docs, carry, keep).select(*[F.col(f"_row.`{c}`") for c in carry], *_GIVEN)


def kept_rows(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay: one for each different text, with the same columns."""
    return _judged(docs, docs.columns, keep).filter("kept").select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of all texts of documents; of equal texts the largest doc_id stays."""
    return _judged(read(spark, sf_dir, "documents", "doc_id", "text"), [], "largest").select("doc_id", *_GIVEN)


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
