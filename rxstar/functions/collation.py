"""Text keys under a collation (K3): exact (binary), or without regard to case.

A column of a collated type can be neither a hash-aggregate key nor a Parquet filter, so keys are
columns of their own: ``fold`` gives the text that stands for all spellings of a name, and joins,
groupings and filters use it.  What is shown is a representative, the smallest spelling by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BINARY = "UTF8_BINARY"
LCASE = "UTF8_LCASE"


def fold(c: Column, collation: str) -> Column:
    """The key of a text: equal for texts that the collation takes for equal."""
    if collation == BINARY:
        return c
    if collation == LCASE:
        return F.lower(c)
    raise ValueError(f"unknown collation {collation}")


def representatives(names: DataFrame, groups: list[str], name: str, collation: str) -> DataFrame:
    """One row for each different key of ``name`` in ``groups``: its smallest spelling.

    Spellings are made distinct first, which is a hash aggregate with map-side combine; what is
    left for the minimum of the texts is the size of the vocabulary.
    """
    found = names.select(*groups, name).distinct()
    if collation == BINARY:
        return found
    return found.groupBy(*groups, fold(F.col(name), collation).alias("_key")).agg(F.min(name).alias(name)).drop("_key")
