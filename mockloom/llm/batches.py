"""Texts of Arrow batches as byte arrays, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: workers are kept between stages, and what one stage held at its peak is another's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``most`` bytes of text, or one row: (rows, bytes, bounds)."""
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, side="right")) - 1)
        yield batch.slice(row, last - row), data[bounds[row]:bounds[last]], bounds[row:last + 1] - bounds[row]
        row = last
