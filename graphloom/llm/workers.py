"""Memory of Python workers, which Spark keeps from task to task and from one kind of task to the next.

Freed memory stays with a worker's C library and Arrow's pool, and tables that one kind of task keeps stay for all that
come after it. So tasks give memory back while they run and at their end, and free what another kind kept.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are worked on at once, so that lists and arrays of results stay small.
ROWS = 1000
#: Seconds between two times that a running task gives memory back.
EVERY = 2.0

_KEPT: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The one large table that a worker keeps; making another frees it."""
    if name not in _KEPT:
        free()
        _KEPT[name] = make()
    return _KEPT[name]


def free(but: str | None = None) -> None:
    """Forget what other kinds of tasks kept."""
    for name in [n for n in _KEPT if n != but]:
        del _KEPT[name]


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _watched(batches: Iterator) -> Iterator:
    last = time.monotonic()
    for b in batches:
        yield b
        del b
        if time.monotonic() - last > EVERY:
            give_back()
            last = time.monotonic()


def thrifty(each: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that frees what other kinds of tasks kept, and gives memory back. keeps: the name of its own table."""

    def call(batches: Iterator) -> Iterator:
        free(keeps)
        try:
            yield from each(_watched(batches))
        finally:
            give_back()

    return call


def column(each: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], kind: str) -> Callable[..., Column]:
    """A column function of such a kind; the task's function is thrifty."""
    work = thrifty(each)

    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from work(batches)

    return F.pandas_udf(call, kind)


def parts(b: pd.DataFrame | pd.Series, rows: int = ROWS) -> Iterator[pd.DataFrame | pd.Series]:
    """A batch in parts of so many rows; an empty one as it is."""
    for i in range(0, max(1, len(b)), rows):
        yield b.iloc[i : i + rows]
