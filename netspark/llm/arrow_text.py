"""Arrow helpers shared by the text operators.

Every text kernel runs under ``mapInArrow``: a task sees its rows as a stream of
record batches, never a whole group, and works on slices of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes a kernel takes at a time; one document may exceed it.
SLICE_BYTES = 1 << 18


def hand_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut batches into runs of rows whose texts hold about ``limit`` bytes.

    Each item is the rows and their ``text`` column as Python strings; only one
    run's strings are made at a time.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, base = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            rows = batch.slice(at, stop - at)
            yield rows, rows.column("text").to_pylist()
            at, base = stop, int(ends[stop - 1])
        hand_back()
