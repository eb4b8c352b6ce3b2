"""Dashboard filters (Q2-Q9): request parameters -> one Column predicate.

Each field of ``Filters`` carries its own specification: the column of the joined star frame it
is compared with, the dimension that column comes from, and the type its text is read as.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from dataclasses import Field, dataclass, field, fields
from typing import Any

from pyspark.sql import Column, functions as F

from ..functions.collation import BINARY, fold


def _equals(column: str, dimension: str | None, read: Callable[[str], Any] = str) -> Any:
    return field(default=None, metadata={"column": column, "dimension": dimension, "read": read})


@dataclass(frozen=True)
class Filters:
    """Equality filters, all optional; the field names are the request's parameter names."""

    city: str | None = _equals("city", "dimCity")
    condition: str | None = _equals("condition", "dimConTh")
    drug: str | None = _equals("drug", "dimDrug")
    type: str | None = _equals("drug_type", "dimDrugType")
    manufacturer: str | None = _equals("manufacturer", "dimMan")
    year: int | None = _equals("timeYear", "dimTime", int)
    refunded: int | None = _equals("is_refunded", None, int)

    @classmethod
    def from_params(cls, params: dict[str, list[str]] | None) -> "Filters":
        """Q9: the first text given for a field, without outer blanks; nothing left means no filter.

        Unknown parameters are passed over.  A year or refund flag that is no integer is a ValueError.
        """
        texts = {f: next(iter((params or {}).get(f.name) or []), "").strip() for f in fields(cls)}
        return cls(**{f.name: f.metadata["read"](text) for f, text in texts.items() if text})

    def _set(self) -> Iterator[tuple[Field, Any]]:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None:
                yield f, value

    def active(self) -> dict[str, object]:
        return {f.name: value for f, value in self._set()}

    def dimensions(self) -> set[str]:
        """Dimension tables the active filters need joined."""
        return {f.metadata["dimension"] for f, _ in self._set()} - {None}

    def members(self) -> dict[str, str]:
        """Name dimension -> the member asked for."""
        return {f.metadata["dimension"]: value for f, value in self._set() if f.metadata["dimension"] not in (None, "dimTime")}

    def predicate(self, collation: str = BINARY) -> Column:
        """AND of the active equality predicates; TRUE when there are none.  Names are compared under the collation."""

        def side(f: Field, c: Column) -> Column:
            return fold(c, collation) if f.metadata["read"] is str else c

        tests = (side(f, F.col(f.metadata["column"])) == side(f, F.lit(value)) for f, value in self._set())
        return functools.reduce(operator.and_, tests, F.lit(True))
