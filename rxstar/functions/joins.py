"""Join helpers: broadcast only behind a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A side is broadcast only if both its counted rows and its estimated bytes
# are within these bounds; bigger sides take a shuffle join (AQE may still
# switch it at run time from real sizes).
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20
ROW_OVERHEAD_BYTES = 32  # per-row cost in the broadcast hash relation, besides the text


def bounded_broadcast(
    df: DataFrame,
    rows: int | None,
    text_bytes: int | None = 0,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """``broadcast(df)`` when its measured size is within the bounds, else ``df``.

    ``rows`` is the counted size of ``df`` and ``text_bytes`` the measured
    bytes of its variable-width columns (callers measure stored tables once).
    ``None`` means unknown, and an unknown size is never broadcast.
    """
    if rows is None or text_bytes is None:
        return df
    if rows <= max_rows and rows * ROW_OVERHEAD_BYTES + text_bytes <= max_bytes:
        return F.broadcast(df)
    return df
