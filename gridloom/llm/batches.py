"""Small working sets for Arrow functions: slices by bytes, and freed memory given back to the system."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one column that a function works on at a time.
SLICE_BYTES = 4 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give what is free back, so that workers which stay for the next task hold little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(batches, column: int, limit: int = SLICE_BYTES):
    """Slices of ``batches`` with about ``limit`` bytes of a string or binary column, at least a row each."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < b.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, int(size.searchsorted(before + limit, "right")))
            yield b.slice(at, end - at)
            at = end
        del b
        release()
