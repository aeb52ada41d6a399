"""Small helpers for ``mapInArrow`` jobs over one text column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.slices import SLICE_BYTES, string_offsets, text_slices


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each row starts (one more than rows); nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(string_offsets(column), dtype=np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def append_columns(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], list],
    fields: list[T.StructField],
    text_col: str = "text",
    drop: tuple[str, ...] = (),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` without ``drop``, plus ``fields`` as computed by ``make`` for slices of each batch.

    An input column with the name of an output column is replaced.
    """
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    schema = T.StructType(keep + fields)
    names = [f.name for f in keep]
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, text_col, slice_bytes):
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(make(piece), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *made], names=[*names, *(f.name for f in fields)])
        pa.default_memory_pool().release_unused()  # workers are kept for later tasks

    return df.mapInArrow(run, schema)
