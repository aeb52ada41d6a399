"""Toxicity scores by a counterfactually regularised linear classifier.

The model is logistic over which words and word beginnings a text holds.  Each labelled text
of the sample that names a member of a group of IDENTITY is written again with all members of
that group exchanged for their neighbours in it; the squared change of the score from the
text to its counterpart is a penalty beside the loss, so naming a group cannot move a score
much in either direction.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns
from .hashing import mix, word_hashes

#: Groups whose members are exchanged for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
#: Lengths of the word beginnings that are features beside the word.
STEMS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")
#: Weight of the mean squared change of the score beside the mean loss.
FAIRNESS = 20.0
#: Bytes of text whose features a task holds at once.
SLICE = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point whether it is part of a word: letters, and marks and numerals that count as such in ``_WORD``."""
    out = np.zeros(0x110000, bool)
    out[:0x10000] = [bool(_WORD.match(chr(c))) for c in range(0x10000)]
    out[0x10000:] = [unicodedata.category(chr(c))[0] in "L" for c in range(0x10000, 0x110000)]
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of all texts and of their beginnings, in lower case, with repeats; whole texts."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _letters()[points]
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    stops = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    raw, row = points.view(np.uint8), np.searchsorted(ends, starts, side="right")
    rows, hashes = [row], [word_hashes(raw, starts * 4, stops * 4)]
    for n in STEMS:
        longer = np.flatnonzero(stops - starts > n)
        rows.append(row[longer])
        hashes.append(mix(word_hashes(raw, starts[longer] * 4, (starts[longer] + n) * 4), n))
    return np.concatenate(rows), np.concatenate(hashes)


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    row, names = features(column)
    order = np.lexsort((names, row))
    row, names = row[order], names[order]
    new = np.append(True, (row[1:] != row[:-1]) | (names[1:] != names[:-1]))[: len(row)]
    row, names = row[new], names[new]
    edge = np.searchsorted(row, np.arange(len(column) + 1))
    return [names[a:b] for a, b in zip(edge, edge[1:])]  # noqa: B905


_NEXT = [{t: group[(i + 1) % len(group)] for i, t in enumerate(group)} for group in IDENTITY]


def counterparts(text: str | None) -> list[str]:
    """The text with the members of a group exchanged for their neighbours, once for each group that it names."""
    low = (text or "").lower()
    named = set(_WORD.findall(low))
    return [_WORD.sub(lambda m, g=group: g.get(m[0], m[0]), low) for group in _NEXT if named & group.keys()]


@dataclass(frozen=True)
class Model:
    bias: float
    names: np.ndarray  # sorted hashes of features
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability that each text is toxic, to six digits."""
        z = np.full(len(column), self.bias)
        if len(self.names):
            row, names = features(column)
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hit = self.names[at] == names
            pairs = np.unique(row[hit] * np.int64(len(self.names)) + at[hit])
            z += np.bincount(pairs // len(self.names), weights=self.weights[pairs % len(self.names)], minlength=len(z))
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def _model(bias: float, weights: dict[int, float] | None = None) -> Model:
    names = sorted(weights or {})
    return Model(float(bias), np.array(names, np.uint64), np.array([weights[n] for n in names], float))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows from whose labels nothing is learnt; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most ``per_class`` training rows of each class, lowest hash first; and class counts.

    Repeated labels count once; ids with labels of both classes are left out.
    """
    said = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other"))
    train = said.filter("label = other").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = [train.filter(F.col("label") == c).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class ids: the bound is a parameter
    some = F.broadcast(picked[0].unionByName(picked[1]))
    return docs.select("doc_id", "text").join(some, "doc_id").select("label", "text"), counts


def _select(rows: list[np.ndarray], labels: np.ndarray, most: int, least_gain: float) -> np.ndarray:
    """Features by likelihood ratio with the label, the strongest first."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([*rows, np.zeros(0, rows[0].dtype)])
    names, at = np.unique(flat, return_inverse=True)
    y = np.repeat(labels, sizes)
    pos = np.bincount(at, weights=y, minlength=len(names))
    seen = np.bincount(at, minlength=len(names))
    p, n = max(labels.sum(), 1.0), max(len(labels), 1)

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)

    gain = 2 * (
        part(pos, seen * p / n)
        + part(seen - pos, seen * (n - p) / n)
        + part(p - pos, (n - seen) * p / n)
        + part(n - p - seen + pos, (n - seen) * (n - p) / n)
    )
    order = np.lexsort((names, -gain))[:most]
    return names[order[(gain[order] >= least_gain) & (seen[order] >= 3)]]


def calibrated(z: np.ndarray, labels: np.ndarray, counts: dict[int, int]) -> tuple[float, float]:
    """Slope and offset that turn scores of rows not learnt from into log odds, rows weighing as their class is frequent."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    weight = np.where(labels == 1, max(counts.get(1, n1), 1) / n1, max(counts.get(0, n0), 1) / n0)
    weight = weight * len(labels) / weight.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # keeps the slope finite where classes are apart
    x = np.stack([z, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - goal)) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(max(w[0], 0.1)), float(w[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, counts: dict[int, int], swaps: list[list[np.ndarray]] | None = None, **options) -> Model:
    """The classifier of all rows, its scores calibrated on those that each half's classifier gives the other half.

    ``rows``: features of each text; ``swaps``: for each text the features of its counterparts.
    """
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    swaps = swaps or [[] for _ in rows]
    if not n1 or not n0:
        return _model(-3.0 if n0 or not n1 else 3.0)
    bias, weights = _fit(rows, labels, swaps, **options)
    if min(n1, n0) < 10:
        shift = np.log((n1 / max(counts.get(1, n1), 1)) / (n0 / max(counts.get(0, n0), 1)))
        return _model(bias - float(shift), weights)
    z = np.zeros(len(rows))
    for half in (0, 1):
        there = np.arange(len(rows)) % 2 == half
        own, part = _fit([r for r, t in zip(rows, there, strict=True) if t], labels[there], [s for s, t in zip(swaps, there, strict=True) if t], **options)
        for i in np.flatnonzero(~there).tolist():
            z[i] = own + sum(part.get(f, 0.0) for f in rows[i].tolist())
    slope, offset = calibrated(z, labels, counts)
    return _model(slope * bias + offset, {f: slope * x for f, x in weights.items()})


def _columns(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the features that are among ``names``."""
    flat = np.concatenate([*rows, np.zeros(0, names.dtype)])
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
    hit = names[column] == flat if len(names) else np.zeros(len(flat), bool)
    return at[hit], column[hit]


def _fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[list[np.ndarray]], most: int = 4096, least_gain: float = 12.0, ridge: float = 1e-3, fairness: float = FAIRNESS, steps: int = 400) -> tuple[float, dict[int, float]]:
    """Logistic regression on the strongest features and all identity terms.

    Minimised: mean loss + ridge / 2 * sum of squared weights + fairness / 2 * mean squared
    change of the score over all pairs of a text and a counterpart.
    """
    terms = feature_sets(pa.array([t for group in IDENTITY for t in group]))
    names = np.unique(np.concatenate([_select(rows, labels, most, least_gain), *terms]))
    at, cols = _columns(rows, names)
    first = np.repeat(np.arange(len(rows)), [len(s) for s in swaps])  # of each counterpart its text
    there, other = _columns([c for s in swaps for c in s], names)
    n, pairs = len(rows), max(len(first), 1)
    w, bias = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(at, weights=w[cols], minlength=n) + bias)
        q = sigmoid(np.bincount(there, weights=w[other], minlength=len(first)) + bias)
        change = fairness * (q - p[first]) / pairs
        up = change * q * (1 - q)  # by the counterpart's log odds, and by the text's
        down = np.bincount(first, weights=change, minlength=n) * p * (1 - p)
        r = (p - labels) / n - down
        g = np.bincount(cols, weights=r[at], minlength=len(names)) + np.bincount(other, weights=up[there], minlength=len(names)) + ridge * w
        g = np.append(g, r.sum() + up.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return float(bias), {int(f): float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _cut(lists: pa.Array, inner=None) -> list:
    """The lists of an array, as views of its numbers, or as what ``inner`` makes of their lists."""
    flat, ends = lists.values, lists.offsets.to_numpy()
    parts = inner(flat) if inner else flat.to_numpy().view(np.uint64)
    return [parts[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, seed: int = 5, **options) -> Model:
    """Fit on a sample of at most 2 * ``per_class`` labelled rows; the model is a bounded set of weights."""
    sample, counts = labelled_sample(docs, labels, per_class, seed)
    longs = T.ArrayType(T.LongType(), False)
    fields = [T.StructField("features", longs, False), T.StructField("swaps", T.ArrayType(longs, False), False)]

    def make(batch: pa.RecordBatch) -> list:
        signed = lambda sets: [s.view(np.int64) for s in sets]
        column = batch.column("text")
        swapped = [signed(feature_sets(pa.array(counterparts(t), pa.string()))) for t in column.to_pylist()]
        return [signed(feature_sets(column)), swapped]

    got = append_columns(sample, make, fields, drop=("text",), slice_bytes=SLICE).toArrow().combine_chunks()
    rows = _cut(_whole(got.column("features")))
    swaps = _cut(_whole(got.column("swaps")), _cut)
    labels_ = got.column("label").to_numpy().astype(float)
    # a fixed order, so that reruns give the same model
    order = sorted(range(len(rows)), key=lambda i: (labels_[i], zlib.crc32(rows[i].tobytes())))
    return fit([rows[i] for i in order], labels_[order], counts, [swaps[i] for i in order], **options)


def score(df: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted``, whole texts; columns of these names are replaced.  Null and empty texts score by the bias alone."""

    def make(batch: pa.RecordBatch) -> list:
        scores = model.scores(batch.column("text"))
        return [scores, (scores >= threshold).astype(np.int32)]

    return append_columns(df, make, [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)], slice_bytes=SLICE)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  Without labels of both classes all rows score alike; an empty table gives no rows."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows that the classifier does not reject, all columns whatever their names; rows are scored by text alone.

    Null and empty texts stay unless the bias alone rejects; rows of equal texts share a decision.  An empty table gives no rows.
    """
    model = train(docs, labels)
    mark = next(n for n in (f"_keep{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return append_columns(docs, lambda b: [model.scores(b.column("text")) < threshold], [T.StructField(mark, T.BooleanType(), False)], slice_bytes=SLICE).filter(mark).drop(mark)
