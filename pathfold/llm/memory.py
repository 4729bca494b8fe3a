"""Python workers outlive their tasks: what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory that the Arrow pool and the C library keep for reuse."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives back its memory when its input ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]):
    """A function for applyInArrow that gives back its memory after each group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return wrapped
