"""Arithmetic of measures.

Prices are DECIMAL(10,2) and their sums stay decimal, so they are exact.  A ratio is one IEEE
division of two exact values and keeps all digits of a DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def as_double(c: Column) -> Column:
    return c.cast(T.DoubleType())


def ratio(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    """num / den as DOUBLE; ``zero`` when den is 0 or NULL."""
    none = F.coalesce(den, F.lit(0)) == 0
    return F.when(none, F.lit(zero).cast(T.DoubleType())).otherwise(as_double(num) / as_double(den))


def round2(c: Column) -> Column:
    """ROUND(x, 2) on a decimal value, half-up."""
    return F.round(c, 2)


def round2_double(c: Column) -> Column:
    """ROUND(x, 2) of a DOUBLE, half-up on its decimal digits (ten places)."""
    return F.round(c.cast(T.DecimalType(38, 10)), 2)
