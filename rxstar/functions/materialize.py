"""Cut lineage by writing a table to the shared folder and reading it back.

Used where a result is read more than once or must not be recomputed
differently after an executor loss.  Parquet keeps column pruning and
statistics, and is much cheaper than a serialized RDD checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


#: Scratch tables and landed rows are written and read a few times: they are kept small.
SCRATCH_CODEC = "zstd"

_MADE: ContextVar[list[str] | None] = ContextVar("scratch folders made", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder, unique per call."""
    path = f"{shared_dir(spark)}/rxstar-stage/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the store itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch folders named within, once what is read from them is stored elsewhere."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path, compression=SCRATCH_CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # a schema of its own: no job to look for it
