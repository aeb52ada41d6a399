"""Where quotes stand in the sections of their course: an index of hashed anchors.

A quote of ``ANCHOR`` characters or more owns one anchor, the window of that many characters
whose hash is least.  Sections slide a window over their whole text and give only hashes that some
quote owns, as a bitmap tells; equal hashes are candidates, and only these are compared as texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.slices import text_slices
from ..scratch import saved

#: Characters of an anchor, and so of the shortest quote.
ANCHOR = 12
#: Windows that a task hashes at once.
STEP = 1 << 20
#: Bits of the bitmap for each quote, and in all at most (32 MB); a fuller map lets more windows through to the join, nothing else.
BITS_EACH, MOST_BITS = 16, 1 << 28
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _windows(text: str):
    """Hashes of all windows of ``ANCHOR`` characters, in pieces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for lo in range(0, len(points) - ANCHOR + 1, STEP):
        piece = points[lo : lo + STEP + ANCHOR - 1].astype(np.uint64)
        n = len(piece) - ANCHOR + 1
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(ANCHOR):
                h = h * _ODD + piece[k : k + n]
            yield _mixed(h)


def _in_course(h: np.ndarray, course: int) -> np.ndarray:
    """Hashes that only windows of the same course share."""
    with np.errstate(over="ignore"):
        return _mixed(h ^ np.uint64(course & (1 << 64) - 1) * _ODD)


def _owned(batches):
    for batch in (piece for whole in batches for piece in text_slices(whole, "q")):
        found = [_in_course(np.array([min(int(h.min()) for h in _windows(q))], np.uint64), c)[0] for q, c in zip(batch.column("q").to_pylist(), batch.column("course").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*batch.schema.names, "anchor"])


def _bitmap(anchors: DataFrame, bits: int) -> np.ndarray:
    place = F.pmod("anchor", F.lit(bits)) + 1
    rows = anchors.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()  # MOST_BITS at most
    out = np.zeros((max(1, bits // 32768), 4096), np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return out.ravel()


def quoted_places(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """(course_id, q, section_id, occurrences): the sections of its course that hold a quote, and how often, without overlap.

    ``quotes``: course_id, q; ``sections``: course_id, section_id, body; both in the same normal form.
    Quotes of fewer than ``ANCHOR`` characters, null quotes and null courses stand nowhere.
    """
    kind = dict(sections.dtypes)
    asked = quotes.filter((F.char_length("q") >= ANCHOR) & F.col("course_id").isNotNull()).select("course_id", "q").distinct()
    asked = asked.select("course_id", "q", F.xxhash64("course_id").alias("course"), F.sha2("q", 256).alias("quote"))
    asked = saved(asked.mapInArrow(_owned, f"course_id {dict(quotes.dtypes)['course_id']}, q string, course long, quote string, anchor long"), "quotes")
    bits = min(MOST_BITS, max(32768, 1 << (asked.count() * BITS_EACH).bit_length()))
    bitmap = _bitmap(asked, bits)

    def hits(batches):
        for batch in (piece for whole in batches for piece in text_slices(whole, "body")):
            rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, (body, course) in enumerate(zip(batch.column("body").to_pylist(), batch.column("course").to_pylist(), strict=True)):
                for h in _windows(body):
                    h = _in_course(h, course)
                    at = h & np.uint64(bits - 1)
                    h = np.unique(h[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                    rows.append(np.full(len(h), i))
                    found.append(h)
            picked = batch.select(["course_id", "section_id"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(found).view(np.int64))], names=["course_id", "section_id", "anchor"])

    bodies = sections.filter(F.col("course_id").isNotNull() & F.col("body").isNotNull()).select("course_id", "section_id", "body")
    there = bodies.withColumn("course", F.xxhash64("course_id")).mapInArrow(hits, f"course_id {kind['course_id']}, section_id {kind['section_id']}, anchor long")
    pairs = there.join(asked.select("course_id", "anchor", "quote"), ["course_id", "anchor"]).select("course_id", "section_id", "quote").distinct()
    texts = pairs.join(asked.select("course_id", "quote", "q"), ["course_id", "quote"]).join(bodies, ["course_id", "section_id"])
    return texts.select("course_id", "q", "section_id", tx.occurrences(F.col("body"), F.col("q")).alias("occurrences")).filter("occurrences > 0")
