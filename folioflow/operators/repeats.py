"""Answers that repeat an earlier one of their conversation.

The measure is ``difflib.SequenceMatcher.ratio``.  Few pairs are measured: of equal answers one;
pairs whose letters in common, as a multiset, cannot reach the ratio are left out; and where
a long answer leaves only so many places at which a matching stretch can begin, one stretch has to be
long, so the two share a short sequence around such a place.  All three bounds are exact.  A
conversation of many answers is dealt into blocks, each pair of blocks a task.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different answers of a block.
BLOCK = 512
#: Letters of a shared sequence.
GRAM = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(points: np.ndarray) -> np.ndarray:
    n = max(len(points) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = h * _ODD + points[k : k + n].astype(np.uint64)
    return h


def anchored(text: str, least: float) -> np.ndarray | None:
    """Sequences of which any text shares one whose ratio with this (earlier) text is ``least`` or more; None where there are no such.

    In texts of 200 letters or more a matching stretch holds a letter that fills at most one in a
    hundred places (and one more), or it stands at the beginning of both; so there are at most as many
    stretches as such places, and one.
    """
    points = _points(text)
    if len(points) < 200:
        return None
    letters, which, counts = np.unique(points, return_inverse=True, return_counts=True)
    rare = counts[which] <= len(points) // 100 + 1
    matched = len(points) * least / (2 - least)  # letters that match at least, since the other text isn't much shorter
    if matched <= (GRAM - 1) * (rare.sum() + 1):
        return None
    held = np.convolve(rare, np.ones(GRAM, int))[GRAM - 1 : len(points)] > 0  # windows with such a letter
    held[0] = True
    return np.unique(_grams(points)[held])


def _counts(texts: list[str]) -> np.ndarray:
    """Letters of each text by residue class: their overlap is at least that of the letters themselves."""
    return np.array([np.bincount(_points(t) & 63, minlength=64) for t in texts], np.int32).reshape(len(texts), 64)


def earliest_repeats(later: list[str], last: list[int], earlier: list[str], first: list[int], least: float) -> tuple[list[int | None], int]:
    """For each text of ``later`` the least ``first`` of an earlier text that it repeats and that is below its ``last``; and the pairs measured."""
    order = sorted(range(len(earlier)), key=first.__getitem__)
    earlier, first = [earlier[i] for i in order], [first[i] for i in order]
    a, b = np.array([len(t) for t in later]), np.array([len(t) for t in earlier])
    common = np.zeros((len(later), len(earlier)), np.int32)
    left, right = _counts(later), _counts(earlier)
    for c in range(64):
        common += np.minimum(left[:, c, None], right[None, :, c])
    may = (2 * common >= least * (a[:, None] + b[None, :]) - 1e-9) & (np.array(first)[None, :] < np.array(last)[:, None])
    keys = [anchored(t, least) for t in earlier]
    bound = np.flatnonzero([k is not None for k in keys])
    if len(bound):
        flat = np.concatenate([keys[i] for i in bound])
        owner = np.repeat(bound, [len(keys[i]) for i in bound])
        by_key = np.argsort(flat, kind="stable")
        flat, owner = flat[by_key], owner[by_key]
        shared = np.zeros_like(may)
        for i, text in enumerate(later):
            mine = np.unique(_grams(_points(text)))
            at = np.minimum(np.searchsorted(mine, flat), max(len(mine) - 1, 0))
            if len(mine):
                shared[i, owner[mine[at] == flat]] = True
        may[:, bound] &= shared[:, bound]
    matchers: dict[int, SequenceMatcher] = {}
    out: list[int | None] = []
    measured = 0
    for i, text in enumerate(later):
        hit = None
        for j in np.flatnonzero(may[i]).tolist():
            m = matchers.get(j) or matchers.setdefault(j, SequenceMatcher(None, "", earlier[j]))
            m.set_seq1(text)
            measured += 1
            if m.ratio() >= least:
                hit = first[j]
                break
        out.append(hit)
    return out, measured


def repeated(answers: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, earlier) of ``answers`` (conv_id, turn, t): the earliest turn that each repeats; turns that repeat none are left out."""
    keyed = answers.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("key", F.sha2("t", 256))
    different = keyed.groupBy("conv_id", "key").agg(F.first("t").alias("t"), F.min("turn").cast("long").alias("first"), F.max("turn").cast("long").alias("last"))
    blocks = keyed.groupBy("conv_id").agg(F.expr(f"cast((count(distinct key) + {block - 1}) div {block} as int)").alias("blocks"))
    dealt = different.join(blocks, "conv_id").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    columns = ["conv_id", "key", "t", "first", "last"]

    def side(name: str, i: Column | str, j: Column | str) -> DataFrame:
        spread = dealt.select(*columns, "own", every)
        return spread.select(*columns, F.lit(name).alias("side"), F.col(i).alias("i"), F.col(j).alias("j"))

    def measure(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        later, earlier = ([r for r in rows if r["side"] == s] for s in ("later", "earlier"))
        found, _ = earliest_repeats([r["t"] for r in later], [r["last"] for r in later], [r["t"] for r in earlier], [r["first"] for r in earlier], least)
        hit = [(r["key"], f) for r, f in zip(later, found, strict=True) if f is not None]
        conv = table.column("conv_id")
        return pa.table({"conv_id": conv.take(pa.array([0] * len(hit), pa.int64())), "key": pa.array([k for k, _ in hit], pa.string()), "earlier": pa.array([f for _, f in hit], pa.int64())})

    met = side("later", "own", "other").unionByName(side("earlier", "other", "own"))
    # a task works on one pair of blocks, so this is bounded whatever the conversation
    found = met.groupBy("conv_id", "i", "j").applyInArrow(measure, f"conv_id {dict(answers.dtypes)['conv_id']}, key string, earlier long")
    least_turn = found.groupBy("conv_id", "key").agg(F.min("earlier").alias("earlier"))
    kind = dict(answers.dtypes)["turn"]
    return keyed.select("conv_id", "turn", "key").distinct().join(least_turn, ["conv_id", "key"]).filter("earlier < turn").groupBy("conv_id", "turn").agg(F.min("earlier").cast(kind).alias("earlier"))
