"""Counts of a text by the classes of its characters: one table lookup a character, over whole slices of texts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

#: Characters that a task works on at once.
SLICE = 1 << 20
LETTER, ALPHABET, SMALL, CAPITAL, VOWEL, USUAL = (1 << k for k in range(6))
#: Letters of the Latin script whose names don't say so: modifier letters, signs named after people or use (fixed values of Unicode).
LATIN_RANGES = ((0x02B0, 0x02B8), (0x02E0, 0x02E4), (0x1D2C, 0x1D5C), (0x1D79, 0x1DBE), (0x212A, 0x212B), (0x2132, 0x2132), (0x214E, 0x214E), (0x2183, 0x2183), (0x2C7D, 0x2C7D), (0xA770, 0xA770), (0xA7F8, 0xA7F9), (0xAB5C, 0xAB5F), (0xAB69, 0xAB69))
_CID = re.compile(r"\(cid:[0-9]+\)")


def is_latin(c: int) -> bool:
    return "LATIN " in unicodedata.name(chr(c), "") or any(a <= c <= b for a, b in LATIN_RANGES)


@lru_cache(maxsize=4)
def classes(usual: str, no_letters: str) -> np.ndarray:
    """Of each code point its classes; ``usual`` beside numbers and Latin letters, ``no_letters`` count as no letters."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x40000):
        category = unicodedata.category(chr(c))
        if category[0] == "L" or category in ("Nl", "No"):
            table[c] |= LETTER
        if category[0] == "N" or (category[0] == "L" and c not in (0xAA, 0xBA) and is_latin(c)):
            table[c] |= USUAL
    for bit, chars in ((ALPHABET | SMALL, tx.FRENCH), (ALPHABET | CAPITAL, tx.FRENCH.upper()), (VOWEL, tx.VOWELS + tx.VOWELS.upper()), (USUAL, usual)):
        table[[ord(c) for c in chars]] |= bit
    table[[ord(c) for c in no_letters]] &= 0xFF ^ LETTER
    return table


def count_words(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Of each text: its words (runs of letters), the plausible ones, and characters that are not usual.

    A plausible word has letters of the alphabet only and one or two of them, or up to thirty with a
    vowel and no capital after the first unless all are.
    """
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    starts_of = np.cumsum([0, *(len(t) + 1 for t in texts)])
    props = table[points]
    letter = (props & LETTER).astype(np.int8)
    edge = np.diff(letter, prepend=0, append=0)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(starts_of, first, side="right") - 1
    words = np.bincount(row, minlength=len(texts))
    good = np.zeros(len(first), bool)
    if len(first):
        props_ = props.copy()
        props_[first] |= SMALL  # a capital may come first
        bounds = np.stack([first, stop], 1).ravel()
        every = np.bitwise_and.reduceat(props_, bounds)[::2]  # a line end follows each text, so the last bound is inside
        some = np.bitwise_or.reduceat(props_, bounds)[::2]
        size = stop - first
        cased = ((every & SMALL) > 0) | ((np.bitwise_and.reduceat(props, bounds)[::2] & CAPITAL) > 0)
        good = ((every & ALPHABET) > 0) & ((size <= 2) | ((size <= 30) & ((some & VOWEL) > 0) & cased))
    odd = np.append(0, np.cumsum((props & USUAL) == 0))[starts_of]
    return np.stack([words, np.bincount(row[good], minlength=len(texts)), np.diff(odd)], 1)


def word_counts(text: Column, usual: str, no_letters: str) -> Column:
    """Struct (cid, length, words, good, odd) of a text; all but ``cid`` with each such marker as one blank."""

    @F.pandas_udf("cid int, length int, words int, good int, odd int")
    def count(texts: pd.Series) -> pd.DataFrame:
        table, out = classes(usual, no_letters), np.zeros((len(texts), 5), np.int32)
        values, lo = texts.to_list(), 0
        while lo < len(values):
            some, held = [], 0
            while lo + len(some) < len(values) and (not some or held < SLICE):
                text, n = _CID.subn(" ", values[lo + len(some)])
                out[lo + len(some), :2] = n, len(text)
                some.append(text)
                held += len(text)
            out[lo : lo + len(some), 2:] = count_words(some, table)
            lo += len(some)
        return pd.DataFrame(out, columns=["cid", "length", "words", "good", "odd"])

    return count(text)
