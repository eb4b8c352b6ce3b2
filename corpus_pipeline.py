"""The corpus pipeline: five stages over documents, each calling one operator of rxstar.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.  Rows
without a doc_id pass through every stage on their text alone; null text counts as empty; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxstar.llm import bpe, exact_dedup, mixing, quality, simhash
from rxstar.llm.common import crc_mod, read, store
from rxstar.sources.tables import table_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score under 0.3).

    It learns from the labelled rows of ``docs``; documents without a single word are rejected or
    kept by their score like any other.
    """
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels, "quality", crc_mod("doc_id", 5) != 0)
    return quality.kept_rows(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    return exact_dedup.kept_rows(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links (4-word shingles, 4 bits) keep the one with the smallest doc_id."""
    return simhash.kept_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the sources at their target weights: a row for each lap that takes a document."""
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("byte-level bpe", bpe_stage),
]

#: SQL cannot express the classifier, the links' components or the tokens; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = store(docs, "stage")
    return docs
