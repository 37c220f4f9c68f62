"""Memory of workers between tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa


def give_back() -> None:
    """What Arrow and the allocator hold for later goes back to the system. Workers live on after a task and may wait beside
    others for long, so each stage gives back what it no longer uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, some at a time, without copying: what Python makes of a batch's texts is held for so many only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
