"""Vectors for passages from a user-supplied encoder, in bounded batches."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed hashed words, normalised."""

    def encode(texts: list[str]) -> np.ndarray:
        words = [text.lower().split() for text in texts]
        flat = [w for ws in words for w in ws]
        known = {w: zlib.crc32(w.encode()) for w in set(flat)}
        h = np.fromiter((known[w] for w in flat), np.int64, len(flat))
        at = np.repeat(np.arange(len(texts)), [len(ws) for ws in words]) * dimension + h % dimension
        out = np.bincount(at, np.where(h & 0x80000000, 1.0, -1.0), len(texts) * dimension).reshape(len(texts), dimension).astype(np.float32)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return encode


def embed(df: DataFrame, text_col: str, encoder: Encoder, batch: int = 16, attempts: int = 3, pause: float = 0.5, longest_pause: float = 4.0) -> DataFrame:
    """Add ``embedding``; no shuffle.  A batch is retried with growing pauses, and must give one vector a text."""
    if batch < 1 or attempts < 1:
        raise ValueError("batch and attempts must be positive")
    schema = T.StructType([f for f in df.schema.fields if f.name != "embedding"] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def once(texts: list[str]) -> list:
        for n in range(attempts):
            try:
                vectors = np.asarray(encoder(texts), dtype=np.float32)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                return list(vectors)
            except Exception:
                if n == attempts - 1:
                    raise
                time.sleep(min(longest_pause, pause * 2**n))
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text_col].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in once(texts[i : i + batch])]
            yield frame.assign(embedding=vectors)[schema.names]

    return df.mapInPandas(run, schema)
