"""Windows over a series; made when asked for, since a window needs a session."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Window, WindowSpec

_stretched: ContextVar[bool] = ContextVar("stretched", default=False)


@contextmanager
def within_stretches() -> Iterator[None]:
    """Series of the windows made inside are stretches of numbered rows."""
    token = _stretched.set(True)
    try:
        yield
    finally:
        _stretched.reset(token)


def series() -> WindowSpec:
    """The rows of one ticker in time."""
    if _stretched.get():
        return Window.partitionBy("Ticker", "__stretch").orderBy("__row")
    return Window.partitionBy("Ticker").orderBy("Datetime")


def whole() -> WindowSpec:
    """All rows of one ticker."""
    return Window.partitionBy("Ticker")
