"""Language identification of texts, with spans of mixed-language texts.

The scripts of a word's letters narrow its languages to those that are written in them; each word
is scored for these by a model of letter sequences, learnt from labelled texts; the best path
of one language a word, with a penalty for each switch (Viterbi), labels the text in spans.
The language of most letters is the text's.

The model counts hashed sequences of up to ``ORDERS`` letters and whole words of a sample of at most
about ``per_lang`` different texts of each language; it's a bounded table.  All texts are labelled whole.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns, text_slices
from .hashing import mix, word_hashes

#: First code points of ranges and their scripts; letters before the first and between ranges are of no script (fixed values of Unicode).
SCRIPT_RANGES = (
    (0x0041, 0x02FF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x08A0, 0x08FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"),
    (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x137F, "Ethiopic"),
    (0x1780, 0x17FF, "Khmer"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x2C60, 0x2C7F, "Latin"),
    (0x3040, 0x309F, "Kana"),
    (0x30A0, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xA720, 0xA7FF, "Latin"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0xF900, 0xFAFF, "Han"),
    (0xFB50, 0xFDFF, "Arabic"),
    (0xFE70, 0xFEFF, "Arabic"),
    (0xFF66, 0xFF9F, "Kana"),
    (0x20000, 0x3FFFF, "Han"),
)
SCRIPTS = ("none", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES))
UNKNOWN = "und"
#: Lengths of the letter sequences that are features beside the whole word.
ORDERS = 4
#: Entries of the model's table, all languages together, at most (powers of two for each language).
TABLE = 1 << 23
#: A language is written in a script if so much of its letters are.
SCRIPT_SHARE = 0.01
#: Bytes of text that a task labels at once, and words of which it holds the letter sequences.
SLICE = 1 << 20
BLOCK = 1 << 15
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("lang", T.StringType(), False)]), False)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: 0, 1 for a letter, 2 for a mark, which belongs to the letter before; its lower case, where that is one; its script."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x40000):
        category = unicodedata.category(chr(c))[0]
        if category == "L":
            kind[c] = 1
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif category == "M":
            kind[c] = 2
    script = np.zeros(0x110000, np.uint8)
    for first, last, name in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return kind, lower, script


@dataclass
class Words:
    """Words of a slice of texts: their lower-case letters, where each starts and stops there and in its text, row and script."""

    letters: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    row: np.ndarray
    at: np.ndarray  # code points before the word in its text
    script: np.ndarray

    def some(self, which) -> Words:
        return Words(self.letters, *(v[which] for v in (self.starts, self.stops, self.row, self.at, self.script)))

    def distinct(self) -> tuple[Words, np.ndarray]:
        """One word of each spelling, and for each word the number of its spelling."""
        hashes = word_hashes(self.letters.view(np.uint8), self.starts * 4, self.stops * 4)
        _, first, spelling = np.unique(hashes, return_index=True, return_inverse=True)
        return self.some(first), spelling


def words_of(column: pa.Array) -> Words:
    """A word is a longest stretch of letters of one script, marks included; a letter without a script goes with its neighbours."""
    kind, lower, script = _letters()
    texts = [t or "" for t in column.to_pylist()]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])
    kinds = kind[points]
    # a mark counts where a letter or mark of a word stands before it
    base = np.maximum.accumulate(np.where(kinds != 2, np.arange(len(points)), 0)) if len(points) else np.zeros(0, np.int64)
    inside = kinds[base] == 1
    of = script[points[base]]
    cut = np.append(True, (of[1:] != of[:-1]))[: len(of)]
    before = np.append(False, inside[:-1])[: len(inside)]
    after = np.append(inside[1:], False)[: len(inside)]
    starts = np.flatnonzero(inside & (~before | cut))
    stops = np.flatnonzero(inside & (~after | np.append(cut[1:], True)[: len(inside)])) + 1
    row = np.searchsorted(ends, starts, side="right")
    first = np.append(0, ends)[row] if len(row) else np.zeros(0, np.int64)
    return Words(lower[points], starts, stops, row, starts - first, of[starts])


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the letter sequences of all words, with the words' edges, and of the words themselves; by order of length."""
    sizes = words.stops - words.starts
    # each word with an edge on both sides
    ends = np.cumsum(sizes + 2)
    begin = ends - sizes - 2
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[begin[of] + 1 + offset] = words.letters[words.starts[of] + offset].astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(sizes)), sizes + 2)
    stop = ends[word]
    rolled = np.zeros(len(flat), np.uint64)
    names, owners = [], []
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            shifted = np.zeros(len(flat), np.uint64)
            shifted[: len(flat) - n + 1] = flat[n - 1 :]
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
            fits = np.flatnonzero((np.arange(len(flat)) + n <= stop) & ((flat > 0) if n == 1 else True))
            names.append(mix(rolled[fits], n))
            owners.append(word[fits])
        if len(sizes):
            powers = np.full(len(flat), np.uint64(0x9E3779B97F4A7C15))
            powers[begin] = 1
            place = np.arange(len(flat)) - begin[word]
            whole = np.add.reduceat(mix(flat ^ (place.astype(np.uint64) << np.uint64(32))), begin)
            names.append(mix(whole, ORDERS + 1))
            owners.append(np.arange(len(sizes)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *owners]), (np.concatenate([np.zeros(0, np.uint64), *names]) & np.uint64(buckets - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # of each bucket and language the log likelihood
    written: np.ndarray  # of each script and language whether it's written so
    clip: float  # a word's score is at most so far below that of its best language
    penalty: float

    def word_scores(self, words: Words) -> np.ndarray:
        """Of each word and language how far its score is below that of the best; other scripts' languages count as furthest.

        Words of a script that no learnt language is written in are alike for all.
        """
        score = np.zeros((len(words.starts), len(self.langs)))
        for lo in range(0, len(score), BLOCK):
            block = words.some(slice(lo, lo + BLOCK))
            owner, bucket = features(block, len(self.table))
            for k in range(len(self.langs)):
                score[lo : lo + BLOCK, k] = np.bincount(owner, weights=self.table[bucket, k], minlength=len(block.starts))
        score /= ORDERS  # sequences of several lengths tell the same letters
        fits = self.written[words.script]
        fits = fits | ~fits.any(axis=1, keepdims=True)
        score[~fits] = -np.inf
        score -= score.max(axis=1, keepdims=True, initial=-np.inf)
        return np.maximum(score, -self.clip)

    def label(self, column: pa.Array) -> tuple[list[str], list[float], list[list[dict]]]:
        """Language, score and spans of each text; spans count code points."""
        words = words_of(column)
        if self.langs:
            spelt, spelling = words.distinct()
            score = self.word_scores(spelt)[spelling]
        else:
            score = np.zeros((len(words.starts), 0))
        path = best_paths(score, words.row, self.penalty)
        size = (words.stops - words.starts).astype(float)
        rows, langs = len(column), len(self.langs)
        held = np.bincount(words.row * max(langs, 1) + path, weights=size, minlength=rows * max(langs, 1)).reshape(rows, max(langs, 1))
        total = held.sum(axis=1)
        best = held.argmax(axis=1) if rows else np.zeros(0, np.int64)
        share = np.where(total > 0, held.max(axis=1, initial=0) / np.maximum(total, 1), 0.0)
        new = np.append(True, (words.row[1:] != words.row[:-1]) | (path[1:] != path[:-1]))[: len(path)]
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(path))[: len(first)] - 1
        spans: list[list[dict]] = [[] for _ in range(rows)]
        stop = words.at + (words.stops - words.starts)
        for a, b in zip(first.tolist(), final.tolist(), strict=True):
            spans[int(words.row[a])].append({"start": int(words.at[a]), "end": int(stop[b]), "lang": self.langs[path[a]] if langs else UNKNOWN})
        return [self.langs[k] if t and langs else UNKNOWN for k, t in zip(best.tolist(), total.tolist(), strict=True)], np.round(share, 6).tolist() if langs else [0.0] * rows, spans


def best_paths(score: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """Of each word its language on its text's best path: the sum of scores less ``penalty`` for each switch.

    Where no stretch of words gains more than one penalty by another language than the text's best,
    no switch pays, whatever their number, and the path is that language; other texts are walked.
    """
    out = np.zeros(len(score), np.int64)
    if score.shape[1] < 2 or not len(score):
        return out
    edges = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    totals = np.add.reduceat(score, edges[:-1], axis=0)
    best = totals.argmax(axis=1)
    out[:] = best[text]
    gain = score - np.take_along_axis(score, best[text][:, None], axis=1)
    # largest sum of a stretch: prefix sums less the smallest before; a fall of this depth between texts keeps them apart
    sums = np.cumsum(gain, axis=0)
    depth = np.abs(gain).sum() + 1
    apart = sums - text[:, None] * depth
    start = np.where((np.arange(len(row)) == edges[:-1][text])[:, None], apart - gain, np.inf)
    lowest = np.minimum.accumulate(np.minimum(start, np.concatenate([start[:1], apart[:-1]])), axis=0)
    walked = np.maximum.reduceat((apart - lowest).max(axis=1), edges[:-1]) > penalty
    for k in np.flatnonzero(walked).tolist():
        out[edges[k] : edges[k + 1]] = viterbi(score[edges[k] : edges[k + 1]], penalty)
    return out


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """The best path through one text; of equally good ones the one that switches latest."""
    n, langs = score.shape
    came = np.empty((n, langs), np.int32)
    held = score[0].copy()
    own = np.arange(langs)
    for t in range(1, n):
        top = int(held.argmax())
        switched = held[top] - penalty
        stay = held >= switched
        came[t] = np.where(stay, own, top)
        held = np.where(stay, held, switched) + score[t]
    path = np.empty(n, np.int64)
    path[-1] = held.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def held_out(id_col: str = "doc_id") -> Column:
    """Rows from which nothing is learnt; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(lang, n): rows to learn from; a row a language, of which the model holds a column."""
    return docs.filter(~held_out()).filter("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def training_sample(docs: DataFrame, per_lang: int, seed: int) -> DataFrame:
    """(lang, text): of each language about ``per_lang`` different texts at most, those of the lowest hashes; equal texts count once."""
    usable = docs.filter(~held_out()).filter("lang IS NOT NULL AND text IS NOT NULL AND text != ''").select(F.col("lang").cast("string").alias("lang"), "text")
    part = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    some = usable.join(F.broadcast(languages(docs)), "lang").filter(part * F.col("n") < per_lang)  # as small as the model
    return some.groupBy("lang", F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text")).drop("same")


def buckets_for(langs: int) -> int:
    """Buckets of each language: a power of two, so that all languages together have ``TABLE`` at most (and each 256 at least)."""
    return max(1 << 8, min(1 << 18, 1 << ((TABLE // max(langs, 1)) or 1).bit_length() - 1))


def train(docs: DataFrame, per_lang: int = 2000, seed: int = 3, clip: float = 4.0, penalty: float = 12.0, smooth: float = 0.5) -> Model:
    """Learn from text and language of rows that are not held out.

    Languages that only texts without letters have are not learnt; without labelled texts the model knows none.
    The table has a bounded number of entries, whatever the number of rows; with many languages it has fewer for each.
    """
    sample = training_sample(docs, per_lang, seed)
    most = buckets_for(languages(docs).count())

    def count(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            order = np.argsort(np.array(langs, object), kind="stable") if langs else []
            known = sorted(set(langs))
            number = {name: k for k, name in enumerate(known)}
            text = batch.column("text").take(pa.array(order, pa.int64()))
            lang = np.array([number[langs[i]] for i in order], np.int64)
            words = words_of(text)
            owner, bucket = features(words, most)
            keys, n = np.unique(lang[words.row[owner]] * np.int64(most) + bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([known[k] for k in (keys // most).tolist()], pa.string()), pa.array(keys % most, pa.int64()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"]
            )
            size = np.bincount(lang[words.row] * len(SCRIPTS) + words.script, weights=words.stops - words.starts, minlength=len(known) * len(SCRIPTS))
            seen = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([known[k] for k in (seen // len(SCRIPTS)).tolist()], pa.string()), pa.array(-1 - seen % len(SCRIPTS), pa.int64()), pa.array(size[seen].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    def sliced(batches):
        return count(piece for batch in batches for piece in text_slices(batch, "text", SLICE // 4))

    counted = sample.mapInArrow(sliced, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # TABLE rows at most, and the scripts
    names = np.array(counted.column("lang").to_pylist(), object)
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    langs = tuple(sorted(set(names.tolist())))
    which = np.searchsorted(np.array(langs, object), names) if len(names) else np.zeros(0, np.int64)
    written = np.zeros((len(SCRIPTS), len(langs)))
    low = bucket < 0
    written[-1 - bucket[low], which[low]] = n[low]
    table = np.zeros((most, len(langs)))
    table[bucket[~low], which[~low]] = n[~low]
    if len(langs):
        table = np.log((table + smooth) / (table.sum(axis=0) + smooth * most))
        table -= table.max(axis=1, keepdims=True)
        written = written / np.maximum(written.sum(axis=0), 1)
    return Model(langs, table.astype(np.float32), written >= SCRIPT_SHARE, clip, penalty)


def identify(df: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Add the language, the share of letters that are in it, and the spans (start, end, lang) in code points.

    Null texts and texts without a letter are ``und`` with score 0 and no spans, as is all if the
    model knows no language; equal texts get equal results; long texts are labelled whole; columns of
    these names are replaced; an empty table stays empty.
    """

    def make(batch: pa.RecordBatch) -> list:
        return list(model.label(batch.column(text_col)))

    fields = [T.StructField(out[0], T.StringType(), False), T.StructField(out[1], T.DoubleType(), False), T.StructField(out[2], SPANS, False)]
    return append_columns(df, make, fields, text_col=text_col, slice_bytes=SLICE)


def language_report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score and the number of spans; ids, languages and sources are no inputs of a prediction."""
    model = train(docs.select("doc_id", "lang", "text"), **options)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
