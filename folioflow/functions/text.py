"""Text functions of the cleaning, repair and review jobs as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of French words, and their vowels (fixed values).
FRENCH = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïñôöùûüÿœæ"
VOWELS = "aeiouyàâäéèêëîïôöùûÿœæ"
#: What patterns call a blank.
BLANKS = " \t\n\x0b\f\r"


def _rx(pattern: str) -> Column:
    return F.lit(pattern)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that it names more than once: as the item of an array the value is computed once."""
    return F.transform(F.array(value), make)[0]


def normalise_text(text: Column) -> Column:
    """One kind of line end, no control characters, no blanks at line ends, at most one empty line, trimmed."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    text = F.regexp_replace(text, "[ \\t]+\\n", "\n")
    text = F.regexp_replace(text, "\\n{3,}", "\n\n")
    return F.btrim(text, F.lit(BLANKS))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+", " ")


def excerpt(text: Column, n: int) -> Column:
    """The trimmed text; if longer than ``n``, cut at the last blank before and marked by an ellipsis."""
    text = F.regexp_replace(text, "^\\s+|\\s+$", "")
    head = F.substring(text, 1, n)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, "\\s+$", ""), F.lit("…")))


def figures_in(text: Column) -> Column:
    """Ids of the figure marks of a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, _rx("\\[FIGURE\\s+([^\\s\\]—]+)"), F.lit(1)))


def digit_key(line: Column) -> Column:
    """The form under which page furniture recurs: no blanks at digits, digit runs as ``#``, blanks collapsed."""
    line = F.regexp_replace(line, "\\s+(?=\\d)|(?<=\\d)\\s+", "")
    line = F.regexp_replace(line, "\\d+", "#")
    return F.trim(collapse_blanks(line))


@lru_cache(maxsize=1)
def _latin_fold() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """From the Unicode data of Latin blocks: single-letter folds, expansions, and combining marks to drop."""
    source, target, expand = [], [], []
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if plain == c.lower() and plain == c:
            continue
        if len(plain) == 1:
            source.append(c)
            target.append(plain)
        else:
            expand.append((c, plain))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(source), "".join(target), tuple(expand), marks


def _class(chars: str) -> str:
    """A character class by ranges: patterns try each of its members in turn."""
    points, runs = sorted(set(map(ord, chars))), []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def fold(text: Column) -> Column:
    """Lower case without accents, straight apostrophes: as NFKD without combining marks for Latin letters."""
    source, target, expand, marks = _latin_fold()
    text = F.translate(text, source + "’" + marks, target + "'")
    wide = text
    for c, plain in expand:
        wide = F.replace(wide, F.lit(c), F.lit(plain))
    # few texts hold a ligature or another letter that becomes several
    return F.lower(F.when(text.rlike(_class("".join(c for c, _ in expand))), wide).otherwise(text))


@lru_cache(maxsize=64)
def _folded_pattern(words: tuple[str, ...]) -> str:
    source, target, _, marks = _latin_fold()
    like = lambda c: _class(c + c.upper() + "".join(s for s, t in zip(source, target, strict=True) if t == c))
    shortest = [w for w in words if not any(v in w for v in words if v != w)]
    return "|".join(f"{_class(marks)}*".join(map(like, w)) for w in shortest)


def fold_contains(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the folded text contains one of the words (of a to z, no k), by one pattern instead of folding all of it."""
    if not all(re.fullmatch("[a-jl-z]+", w) for w in words):
        raise ValueError("words of a to z without k: signs and the kelvin sign fold in other ways")
    expand = _class("".join(c for c, _ in _latin_fold()[2]))
    folded = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(fold(text), w))
    return F.when(text.rlike(expand), folded).otherwise(text.rlike(_folded_pattern(words)))


def same_text_key(text: Column) -> Column:
    """Texts with equal keys say the same: folded, blanks collapsed, punctuation at the edges dropped."""
    return F.regexp_replace(collapse_blanks(F.trim(fold(text))), "^[ .;:,!?]+|[ .;:,!?]+$", "")


def dehyphenate(text: Column) -> Column:
    """Join words cut by a hyphen at the end of a line."""
    return F.regexp_replace(text, "(?U)(\\w)-\\n(\\w)", "$1$2")


def mend_elisions(text: Column) -> Column:
    """``d' octobre`` to ``d'octobre``."""
    return F.regexp_replace(text, "(?iU)\\b([cdjlmnst]|qu)([’']) (?=[\\p{L}])", "$1$2")


def sentences(text: Column) -> Column:
    """Cut after closing punctuation and blanks before an opening character."""
    return F.split(text, "(?<=[.!?…])\\s+(?=[«\"'(\\[]?[A-ZÀ-ÖØ-Þ0-9])")


#: What a note line may hold beside letters, digits, blanks and underscores.
NOTE_SIGNS = ".,;:!?'\"«»()[]{}-–—+*/=<>%°$€£§&@#^~|\\√∑∏∫∞≈≠≤≥±×÷→←↔⇒⇔∈∉⊂∪∩∅"
#: Reasons for which a note line looks broken, in the order they are tried.
BROKEN = ("PARENTHESE_NON_FERMEE", "CARACTERES_INATTENDUS", "CARACTERE_ILLISIBLE", "MOTS_AGGLUTINES")


def broken_reason(line: Column) -> Column:
    """Why a note line looks broken, the first that holds, else an empty string."""
    line = F.regexp_replace(line, "^\\s+|\\s+$", "")
    count = lambda p: F.regexp_count(line, _rx(p))
    unbalanced = (count("\\(") != count("\\)")) | (count("\\[") != count("\\]")) | (count("\\{") != count("\\}"))
    signs = "".join("\\" + c if c in "\\[]^-&~|{}()" else c for c in NOTE_SIGNS)
    noise = F.char_length(F.regexp_replace(line, f"[\\p{{L}}\\p{{N}}_\\s{signs}]", ""))
    words = F.regexp_extract_all(line, _rx("[\\p{L}\\p{Nl}\\p{No}]{2,}"), F.lit(0))
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.char_length(w)) / F.greatest(F.size(words), F.lit(1))
    return (
        F.when(unbalanced, F.lit(BROKEN[0]))
        .when((F.char_length(line) >= 10) & (noise > 0.2 * F.char_length(line)), F.lit(BROKEN[1]))
        .when(F.contains(line, F.lit("\ufffd")), F.lit(BROKEN[2]))
        .when(mean > 18, F.lit(BROKEN[3]))
        .otherwise(F.lit(""))
    )


def excessive_rewrite(before: Column, after: Column) -> Column:
    """More than 12 characters and more than 40 % longer or shorter."""
    change = F.abs(F.char_length(after) - F.char_length(before))
    return (F.char_length(before) == 0) | ((change > 12) & (change / F.char_length(before) > 0.4))


def markdown_row(cells: Column) -> Column:
    """``| a | b |`` of an array of cells."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.trim(collapse_blanks(c))), " | "), F.lit(" |"))


def markdown_cells(row: Column) -> Column:
    """Cells of a Markdown row, trimmed; the bars at its edges are no cells."""
    inner = F.regexp_replace(F.trim(row), "^\\||\\|$", "")
    return F.transform(F.split(inner, "\\|", -1), lambda c: F.trim(c))


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text, without overlap; an empty quote never."""
    gone = F.char_length(text) - F.char_length(F.replace(text, quote, F.lit("")))
    return F.when(F.char_length(quote) > 0, (gone / F.char_length(quote)).cast("int")).otherwise(F.lit(0))


#: Items that one step of a running sum copies.
STEP = 256


def running_sum(values: Column) -> Column:
    """Running sums of an array of integers, in steps, so that no long array is copied again and again."""

    def within(first: Column, items: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")))

    def summed(values: Column) -> Column:
        def step(acc: Column, at: Column) -> Column:
            done = within(acc["at"], F.slice(values, at, STEP))
            return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        steps = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(steps, start, step)["out"])

    # bound as the item of an array: the values are computed once, not once a step
    return F.transform(F.array(values), summed)[0]


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, match), in code points: what lies between them gives the starts."""

    def placed(cut: Column) -> Column:
        found, gaps = cut["found"], F.slice(cut["gaps"], 1, F.size(cut["found"]))
        ends = running_sum(F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("match")))

    cut = F.struct(F.regexp_extract_all(text, _rx(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    made = F.transform(F.array(cut), placed)[0]
    # most texts have no match, and then nothing else is looked at
    return F.when(F.regexp_like(text, _rx(pattern)), made).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def around(text: Column, start: Column, end: Column, n: int) -> Column:
    """The span with ``n`` characters on either side."""
    low = F.greatest(start - n, F.lit(0))
    return F.substr(text, low + 1, end + n - low)
