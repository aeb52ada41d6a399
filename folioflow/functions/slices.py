"""Batches cut into slices of bounded text, so that a task holds few texts as Python values at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once; a longer single text is one slice.
SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``size`` bytes of text."""
    if not batch.num_rows:
        return
    offsets = np.frombuffer(string_offsets(batch.column(column)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def string_offsets(column: pa.Array) -> bytes:
    """Offsets of a string or binary array as int64, starting at those of its first row."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind, count=len(column) + column.offset + 1)
    return raw[column.offset :].astype(np.int64).tobytes()
