"""Small helpers shared by the pipeline operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.materialize import scratch_path
from ..functions.once import once
from ..sources.tables import table_path

#: A word, in every contract: a run without ASCII white space (Java and Python syntax alike).
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application.

    Spark sends the archive to the executors itself, so a job works the same when the
    package is not installed on them.
    """

    def send() -> bool:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        path = os.path.join(tempfile.mkdtemp(prefix="rxstar-py-"), "rxstar_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(os.path.join(root, "rxstar")):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(path)
        return True

    once(_SHIPPED, spark.sparkContext.applicationId, send)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, with only these columns in the scan."""
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe against lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the value written as text, modulo m (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def fixed_rows(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size``."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Cut sorted batches between runs of equal keys.

    Each table holds whole runs: as many as are needed to reach ``least`` rows.  Memory holds
    one such table and one batch, so it is bounded by the largest run.
    """
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        begin = 0
        for i, key in enumerate(zip(*cols)):
            if last is not None and key != last and count + i - begin >= least:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held)
                held, count, begin = [], 0, i
            last = key
        held.append(batch.slice(begin))
        count += batch.num_rows - begin
    if held:
        yield pa.Table.from_batches(held)
