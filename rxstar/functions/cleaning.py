"""Scalar cleaning rules of the staging step, as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Fixed values of the reference's staging rules.
TIMESTAMP_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
# MySQL '%Y-%m-%d %H:%i:%s': every part but the year may be unpadded.
TIMESTAMP_LOOSE = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$"
TRUE_FLAGS = ["1", "true", "yes", "y", "t"]
BLANK_LABEL = "Unknown"
TEXT_LIMIT = 1000
LIST_SEPARATOR = ", "


def parse_sale_timestamp(c: Column) -> Column:
    """ISO-looking text is cast, anything else parsed with the loose format; NULL if neither works.

    Both paths produce TIMESTAMP_NTZ directly (wall-clock fields, no session
    time zone), so a DST gap in the session zone cannot shift a value.
    """
    part = lambda i: F.regexp_extract(c, TIMESTAMP_LOOSE, i).try_cast(T.IntegerType())
    loose = F.when(
        c.rlike(TIMESTAMP_LOOSE),
        F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6).cast(T.DecimalType(16, 6))),
    )
    return F.when(c.rlike(TIMESTAMP_PREFIX), c.try_cast(T.TimestampNTZType())).otherwise(loose)


def trim_spaces(c: Column) -> Column:
    """Strip leading and trailing spaces (not tabs)."""
    return F.trim(c)


def parse_price(c: Column) -> Column:
    """Decimal comma becomes a point, then DECIMAL(10,2) rounded half-up; NULL if not a number."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast(T.DecimalType(10, 2))


def normalize_flag(c: Column) -> Column:
    """T4: 1 for the accepted truthy words, 0 for everything else including NULL."""
    return F.when(F.lower(F.trim(c)).isin(TRUE_FLAGS), F.lit(1)).otherwise(F.lit(0))


def truncate_text(c: Column, limit: int = TEXT_LIMIT) -> Column:
    """First ``limit`` characters of the whole value."""
    return F.left(c, F.lit(limit))


def list_to_text(c: Column, dtype: T.DataType) -> Column:
    """An array is joined with ', '; a scalar passes through; NULL stays NULL."""
    if isinstance(dtype, T.ArrayType):
        return F.array_join(c.cast(T.ArrayType(T.StringType())), LIST_SEPARATOR)
    return c.cast(T.StringType())


def first_of_list(c: Column) -> Column:
    """Element 0 of an array, NULL for a NULL or empty array."""
    return F.get(c, 0)


def blank_to_label(c: Column, label: str = BLANK_LABEL) -> Column:
    """COALESCE(NULLIF(x, ''), label)."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def first_present(*cols: Column) -> Column:
    """Python ``a or b``: the first value that is neither NULL nor empty; the last one otherwise."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)
