"""Training rows for the classifiers: a bounded, balanced, reproducible sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import texts

#: Documented bound: at most so many rows of each class are used for training.
MAX_OF_CLASS = 4000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int = MAX_OF_CLASS) -> DataFrame:
    """(text binary, y int, weight double) of at most ``bound`` rows of each class.

    ``train`` selects the rows that may be learnt from (on doc_id).  Which rows a class gives is
    set by a hash of doc_id.  The weights restore the shares that the classes have among all
    labelled rows.  Null labels and ids are left out; a document labelled more than once has the
    majority's label (ties: 1), and one of several rows with the same id.  The ids are broadcast: two bounds of rows at most.
    """
    of = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
    of = of.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in of.groupBy("y").count().collect()}
    parts = [
        of.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("weight", F.lit(max(1.0, n / bound)))
        for y, n in sorted(counts.items())
    ]
    chosen = parts[0] if parts else of.withColumn("weight", F.lit(1.0))
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rows = docs.select("doc_id", texts().alias("text")).join(F.broadcast(chosen), "doc_id")
    # a row for each id: of several the one with the smallest hash of its text (map-side combined)
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    return rows.groupBy("doc_id", "y", "weight").agg(one).select("text", "y", "weight")
