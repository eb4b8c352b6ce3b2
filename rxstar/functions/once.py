"""Build a stored table once per application, also when queries run from several threads."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")

_LOCK = threading.RLock()


def once(cache: dict, key, build: Callable[[], T]) -> T:
    """``cache[key]``, built by ``build()`` under a lock the first time."""
    if key in cache:
        return cache[key]
    with _LOCK:
        if key not in cache:
            cache[key] = build()
        return cache[key]
