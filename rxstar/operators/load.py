"""Load of a source table: one read of its pages gives the rows, the current table and the bookkeeping.

The counts are metrics of the write of the flattened records.  That write has no shuffle, so it
consists of result tasks, and Spark takes the metrics of a result task once, however often it is run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.materialize import materialize
from ..schemas import SOURCE_METADATA
from ..sources.openfda import records
from .upsert import SOURCES, keep_last


@dataclass
class LoadedSource:
    """What a load gives: all records (with ``seq``), the current rows, and the metadata row."""

    records: DataFrame
    current: DataFrame
    metadata: DataFrame


def load_source(
    pages: DataFrame, flatten: Callable[[DataFrame], DataFrame], source_key: str, key: list[str], fetched_at: str
) -> LoadedSource:
    """Read ``pages`` once: S4/S6 rows stored, keep-last by ``key`` (U2), records and total counted."""
    spark = pages.sparkSession
    header, rows = Observation(), Observation()
    seen = pages.observe(header, F.max_by("meta.results.total", "skip").alias("total"))
    flat = flatten(records(seen)).observe(rows, F.count(F.lit(1)).alias("n"))
    stored = materialize(flat, source_key)
    name, url = SOURCES[source_key]
    row = (source_key, name, url, rows.get["n"], header.get["total"], fetched_at)
    metadata = spark.createDataFrame([row], SOURCE_METADATA)
    return LoadedSource(stored, keep_last(stored, key, ["seq"]).drop("seq"), metadata)
