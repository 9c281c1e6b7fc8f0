"""Memory that a reused Python worker would keep between tasks.

A worker goes on with the tasks of other operators and stages. What its allocators hold of freed memory adds up to the
largest peak of every operator so far, beside the heap of the executor.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The way of glibc to return freed pages; other C libraries have none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)
