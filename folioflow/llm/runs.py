"""Periodic runs in texts: stretches of words that repeat with one period.

Dictionary of basic factors: for each power of two, equal stretches of that many words of a text
get one name, made from the names of their halves.  Occurrences of a name follow each other;
where successors within that length stand equally far apart over consecutive words they form
arithmetic progressions, whose distance is a period and which extend to the whole run.  Farther
successors come back at the next length, nearer ones have been found at the one before, so each
run is proposed once.  Stretches that occur once in a text are left out of longer ones.

All of it is numpy on whole slices of texts; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns, text_bytes
from .hashing import ODD, mix, same_words, word_hashes
from .text import word_bounds

#: Words of a run, and periods that it holds, at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Bytes of text whose words a task holds at once; a longer text is one slice.
SLICE = 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def word_names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An integer for each word, equal for equal words of a row only; -1 for words that a row holds once."""
    keys = mix(word_hashes(raw, starts, ends) ^ row.astype(np.uint64) * ODD[3])
    order = np.argsort(keys, kind="stable")
    a, b = order[:-1], order[1:]
    alike = keys[a] == keys[b]
    x, y = a[alike], b[alike]
    if (row[x] == row[y]).all() and same_words(raw, starts[x], ends[x], raw, starts[y], ends[y]).all():
        return _named(order, alike)
    known: dict[tuple[int, bytes], int] = {}  # words that share a hash
    words = np.array([known.setdefault((r, raw[s:e].tobytes()), len(known)) for r, s, e in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True)], np.int64)
    order = np.argsort(words, kind="stable")
    return _named(order, words[order[:-1]] == words[order[1:]])


def _named(order: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Names by group of equal neighbours in ``order``; -1 for groups of one."""
    names = np.empty(len(order), np.int64)
    new = np.append(True, ~alike)[: len(order)]
    group = np.cumsum(new) - 1
    names[order] = np.where(np.bincount(group)[group] > 1, group, -1)
    return names


def _intervals(at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and gap of each stretch of consecutive places of one gap; places ascend."""
    if not len(at):
        return at, at, gap
    new = np.append(True, (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1]))
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1], gap[first]


def find_runs(names: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods, by start and period.

    ``names``: of each word, those of different rows differ; ``last``: where the row of each word
    ends.  A run's period is its smallest, and no neighbouring word extends it.
    """
    found, size = [], 1
    places = np.flatnonzero(names >= 0)
    while len(places):
        # equal names in a row, by name and place
        order = places[np.argsort(names[places], kind="stable")]
        a, b = order[:-1], order[1:]
        gap = np.where(names[a] == names[b], b - a, 0)
        near = (gap * 2 > size) & (gap <= size)
        at, gap = a[near], gap[near]
        by_place = np.argsort(at)
        first, final, period = _intervals(at[by_place], gap[by_place])
        # within a stretch of this many words at distance `period`, whose length is at least the period, no smaller period holds,
        # and a neighbouring word that repeated too would belong to the progression
        length = final - first + period + size
        good = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * period)
        found.append((first[good], length[good], period[good]))
        places = places[places + 2 * size <= last[places]]
        places = places[names[places + size] >= 0]
        left, right = names[places], names[places + size]
        order = np.argsort(left * (len(names) + 1) + right, kind="stable")
        left, right = left[order], right[order]
        longer = np.full(len(names), -1, np.int64)
        longer[places] = _named(order, (left[1:] == left[:-1]) & (right[1:] == right[:-1]))
        names, size = longer, size * 2
        places = places[names[places] >= 0]
    start, length, period = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def dropped_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of n words those that some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def _joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Of each row its words joined by single spaces."""
    sizes = ends - starts + 1  # each with the space after it
    stop = np.cumsum(sizes)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    places = np.arange(len(out)) + np.repeat(starts - (stop - sizes), sizes)
    inside = np.ones(len(out), bool)
    inside[stop - 1] = False
    out[inside] = raw[places[inside]]
    # the space after a row's last word goes
    words = np.searchsorted(row, np.arange(rows + 1))
    bounds = np.append(0, stop)[words]
    full = np.diff(words) > 0
    keep = np.ones(len(out), bool)
    keep[bounds[1:][full] - 1] = False
    offsets = np.append(0, np.cumsum(np.diff(bounds) - full)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[keep].tobytes()))


def runs_and_rest(column: pa.Array) -> tuple[list[list[dict]], pa.Array]:
    """Of each text its runs, and its words without the repeats in them."""
    raw, offsets = text_bytes(column)
    starts, ends = word_bounds(raw, offsets)
    bounds = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    start, length, period = find_runs(word_names(raw, starts, ends, row), bounds[1:][row])
    keep = ~dropped_words(len(starts), start, length, period)
    lists: list[list[dict]] = [[] for _ in range(len(column))]
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        at = int(row[s])
        lists[at].append({"start": s - int(bounds[at]), "length": n, "period": p})
    return lists, _joined_words(raw, starts[keep], ends[keep], row[keep], len(column))


def collapse(df: DataFrame, text_col: str = "text", runs_col: str = "runs", out: str = "collapsed") -> DataFrame:
    """Add ``runs``, an array of (start, length, period) in words by start and period, and ``collapsed``, the text without the repeats.

    Words are separated by spaces and the characters 9 to 13 and joined again by one space; a word
    stays unless some run holds it after its first period.  Null texts have no runs and collapse to
    an empty text, as do texts without words; a text is one piece of work, however long; repeated
    rows stay; columns of these two names are replaced; an empty table stays empty.
    """

    def make(batch: pa.RecordBatch) -> list:
        lists, rest = runs_and_rest(batch.column(text_col))
        return [lists, rest.cast(pa.string())]

    return append_columns(df, make, [T.StructField(runs_col, RUNS, False), T.StructField(out, T.StringType(), False)], text_col=text_col, slice_bytes=SLICE)


def planted(text: Column, id_: Column) -> Column:
    """The text whose words repeat from a place on, for one id in ten; other texts as they are (ids that are null too)."""
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        at = F.sequence(F.lit(0), n - 1)
        return F.array_join(F.transform(at, lambda i: F.element_at(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1)), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(text))[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, made).otherwise(text)


def runs_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, number of runs, the run of the greatest exponent, digests of all runs and of the collapsed text.

    Runs are those of the text with ``planted`` repeats.  Null ids plant nothing; null and empty
    texts give no runs and the digest of an empty text; of runs of one exponent the first counts.
    """
    found = collapse(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))).drop("text")
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(RUNS.elementType), better)
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[k].alias(k) for k in ("start", "length", "period")),
        F.floor(F.expr("best.length * 1000 div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
