"""What a Python worker holds from task to task, and when it gives memory back.

Workers are reused, so what one operator leaves in them adds to what the next one needs. A worker holds the tables of one
kind of work at most: whoever needs others, or none, has these dropped first, and freed memory returns to the system.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_HELD: dict[tuple, Any] = {}


def give_back() -> None:
    """Freed memory returns to the system, as far as the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held(kind: str, make: Callable[..., Any], *key: Any) -> Any:
    """``make(*key)``, kept until another kind of work, or the same with another key, comes to this process."""
    if (kind, *key) not in _HELD:
        vacate()
        _HELD[kind, *key] = make(*key)
        give_back()
    return _HELD[kind, *key]


def vacate() -> None:
    if _HELD:
        _HELD.clear()
        give_back()


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that needs nothing held, and gives back at its end what it used."""

    @functools.wraps(run)
    def own(*args: Any) -> Iterator:
        vacate()
        try:
            yield from run(*args)
        finally:
            give_back()

    return own
