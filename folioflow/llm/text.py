"""Words of texts as numpy arrays over the UTF-8 bytes of a whole slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import text_bytes

#: White space that separates words: space and the bytes 9 to 13 (fixed value).
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words don't reach across rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each row; a null text has none."""
    raw, offsets = text_bytes(column)
    starts, _ = word_bounds(raw, offsets)
    return np.diff(np.searchsorted(starts, offsets))
