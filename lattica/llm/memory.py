"""Python workers that give their memory back after each task.

Spark keeps a worker for the next task, also for one of another operator. What a
task has freed stays with the allocators of such a worker, so an executor would
hold the most that any operator ever took, beside a heap that has grown meanwhile.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Hand freed memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def tidy(run: Callable[[_Batches], _Batches]) -> Callable[[_Batches], _Batches]:
    """``run`` for mapInArrow, with the memory handed back at the end of the task."""

    def wrapped(batches: _Batches) -> _Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
