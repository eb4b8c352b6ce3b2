"""Incremental openFDA event load with Structured Streaming.

The same load as the batch loader, run as new pages land: ``readStream`` over
the landing directory (explicit schema), flatten each micro-batch, and append
it to a log table, one partition per batch (``foreachBatch``).  A batch
overwrites only its own partition, so a re-run after a failure is idempotent.
The current table is resolved on read: keep-last per ``safetyreportid`` in
(run, position) order, the reference's INSERT OR REPLACE order; a run is a
crawl, or a batch where the pages are not landed by crawl.  No batch
rewrites the whole table, and the keep-last is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.sinks import commit_version, latest_version, version_path
from ..operators.upsert import keep_last
from ..sources.landing import page_schema
from ..sources.openfda import flatten_events, records


def start_event_stream(
    spark: SparkSession,
    landing_path: str,
    log_path: str,
    checkpoint_path: str,
    max_files_per_trigger: int = 1,
    available_now: bool = True,
):
    """Start the stream; returns the StreamingQuery (``available_now`` drains what has landed, then stops)."""
    # pages of one crawl may be landed under run=<number>; they are ordered by their offsets, whenever they arrive
    pages = (
        spark.readStream.schema(T.StructType([*page_schema("event").fields, T.StructField("run", T.LongType(), True)]))
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(landing_path)
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a page without a run belongs to the run of its batch
        run = F.coalesce("run", F.lit(batch_id).cast("long"))
        flat = flatten_events(records(batch.withColumn("run", run), ("run",)), ("run",))
        flat.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    writer = pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


_ORDER = ["run", "seq", "batch_id"]


def _latest(log: DataFrame) -> DataFrame:
    """Keep-last by report, in (run, position, batch) order; the three columns stay."""
    return keep_last(log, ["safetyreportid"], _ORDER)


def current_events(spark: SparkSession, log_path: str) -> DataFrame:
    """The source_drug_events table as of the last committed batch, from the whole log."""
    return _latest(spark.read.parquet(log_path)).drop(*_ORDER)


def batches_written(spark: SparkSession, log_path: str) -> DataFrame:
    """Rows per micro-batch in the log (bookkeeping of the incremental load)."""
    return spark.read.parquet(log_path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("records"))


def compact_events(spark: SparkSession, log_path: str, base: str) -> str:
    """Publish the keep-last snapshot as a new version (P5): the last one, and the batches after it.

    The snapshot keeps each row's batch and position, and its version records the last batch it
    holds, so ``snapshot_and_tail`` and the next compaction read only the batches after that.
    """
    through = spark.read.parquet(log_path).agg(F.max("batch_id")).first()[0]
    version = latest_version(spark, base) + 1
    path = version_path(base, version)
    _latest(_snapshot_rows(spark, log_path, base)).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version, through)], _THROUGH).write.mode("overwrite").parquet(f"{base}/_through/version={version}")
    commit_version(spark, base, version)
    return path


_THROUGH = "number long, batch_id long"


def _snapshot_rows(spark: SparkSession, log_path: str, base: str) -> DataFrame:
    """Rows of the newest snapshot and of the log's later batches (all batches where there is no snapshot)."""
    log = spark.read.parquet(log_path)
    version = latest_version(spark, base)
    if not version:
        return log
    through = spark.read.schema(_THROUGH).parquet(f"{base}/_through/version={version}").first()["batch_id"]
    tail = log.where(F.col("batch_id") > F.lit(-1 if through is None else through))  # whole folders are left out
    return spark.read.schema(log.schema).parquet(version_path(base, version)).unionByName(tail)


def snapshot_and_tail(spark: SparkSession, log_path: str, base: str) -> DataFrame:
    """The table as of the last committed batch: the newest snapshot with the batches after it."""
    return _latest(_snapshot_rows(spark, log_path, base)).drop(*_ORDER)
