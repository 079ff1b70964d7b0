"""Arrow batches in slices of bounded size, so that a task's memory does not follow the length of its texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows of a slice; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256
_C = ctypes.CDLL(None)


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of the text or binary in `column`."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(lengths)
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(upto, (upto[first - 1] if first else 0) + size, "right"))
        last = min(max(first + 1, last), first + rows, len(batch))
        yield batch.slice(first, last - first)
        first = last


def give_back() -> None:
    """Returns freed memory of this worker to the system, where the C library can; called when a task is done."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim is not None:
        trim(0)
