"""Python workers outlive their tasks; these give a task's memory back when it ends."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable
from functools import wraps

import pyarrow as pa

#: Threads of the tokenizers library in a worker: an executor has a worker for each of its cores.
os.environ.setdefault("RAYON_NUM_THREADS", "2")
#: Number of mallopt's parameter for the number of malloc's arenas.
_M_ARENA_MAX = -8

try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(_M_ARENA_MAX, 2)
    _trim = _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(function: Callable) -> Callable:
    """A function for mapInArrow that releases memory at the end of its task."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run
