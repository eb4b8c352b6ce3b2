"""Exact distinct counts of dense ids by bitmaps: one pass, no row expansion, no shuffle of ids.

A task keeps one bitmap of 4 KB for each 32,768 ids of a column and passes those on; merging is a
bitwise OR.  Counting several columns costs one aggregate, where distinct aggregates would copy each
row for each column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IDS_PER_BITMAP = 1 << 15
#: At most so many bitmaps in one aggregate (2,097,152 ids); beyond that a distinct aggregate is the plan.
MAX_BITMAPS = 64


def bitmaps_needed(largest: int) -> int:
    return -(-max(largest, 1) // IDS_PER_BITMAP)


def bitmap_parts(ids: Column, largest: int) -> list[Column]:
    """Aggregates: one bitmap for each run of 32,768 positive ids up to ``largest``."""
    where = F.bitmap_bit_position(ids)
    return [
        F.bitmap_construct_agg(F.when((ids > b * IDS_PER_BITMAP) & (ids <= min((b + 1) * IDS_PER_BITMAP, largest)), where))
        for b in range(bitmaps_needed(largest))
    ]


def bits(parts: list[Column]) -> Column:
    """How many different ids the bitmaps of one column hold."""
    return sum((F.coalesce(F.bitmap_count(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.bitmap_count(parts[0]), F.lit(0)))
