"""Clean-up of assembled documents: page furniture, broken lines, split words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Words that count as words though they are short.
GRAMMAR = (
    "a", "à", "y", "au", "ai", "as", "ce", "de", "du", "en", "es", "et", "eu", "il", "je", "la", "le", "ma", "me",
    "ne", "ni", "nos", "on", "ou", "où", "sa", "se", "si", "ta", "te", "tu", "un", "va", "vu", "vos", "par", "sur",
    "les", "des", "aux", "est", "son", "ses", "mes", "tes", "que", "qui",
)
#: A closed set every vocabulary holds.
CALENDAR = (
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre",
    "décembre", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche",
)
PAGE_MARK = "(?m)^## p\\. \\d+$"
#: What goes at the ends of a page.
PAGE_BLANKS = " \t\n\f\r"
#: What begins a list item, and what ends a sentence.
LIST_ITEM = "^\\s*([-•*—]|\\d+[.)])\\s+"
ENDS = "[.!?…:;»\"]\\s*$"


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): filled pages in order, each under its marker."""
    return join_pages(pages.filter(F.coalesce("text", F.lit("")).rlike("\\S")))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): all pages in order, each under its marker; of a blank page the marker stays."""
    body = F.concat(F.lit("## p. "), F.col("page_no").cast("string"), F.lit("\n\n"), F.btrim(F.coalesce("text", F.lit("")), F.lit(PAGE_BLANKS)))
    packed = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", body.alias("body")))).alias("p"))
    return packed.select("doc_id", F.array_join(F.transform("p", lambda x: x["body"]), "\n\n").alias("text"))


def split_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) of documents with page markers; what stands before the first marker is dropped."""
    numbers = F.regexp_extract_all("text", F.lit("(?m)^## p\\. (\\d+)$"), F.lit(1))
    parts = F.slice(F.split("text", PAGE_MARK, -1), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    pairs = F.arrays_zip(numbers.alias("no"), parts.alias("body"))
    return docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.col("p.no").cast("int").alias("page_no"), F.col("p.body").alias("text"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Filled lines of pages, trimmed, with their rank from the top and from the bottom."""
    cut = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cut = cut.withColumn("line", F.regexp_replace("line", "^\\s+|\\s+$", "")).filter("line != ''")
    w = Window.partitionBy("doc_id", "page_no")
    return cut.withColumn("top", F.row_number().over(w.orderBy("line_no"))).withColumn("bottom", F.row_number().over(w.orderBy(F.desc("line_no"))))


def repeated_lines(pages: DataFrame, share: float = 0.04) -> DataFrame:
    """(doc_id, key): keys of lines that recur at the edges of a document's pages.

    Among the first two and last three lines of a page, once for each different line; with a
    digit, no table row, 3 to 120 characters; on at least max(3, share of pages) pages, and
    never in documents under three pages.
    """
    edges = page_lines(pages).filter("top <= 2 or bottom <= 3").select("doc_id", "page_no", "line").distinct()
    fit = edges.filter(~F.col("line").startswith("|") & F.col("line").rlike("\\p{Nd}") & F.char_length("line").between(3, 120))
    counted = fit.groupBy("doc_id", tx.digit_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages")).filter("pages >= 3")
    return counted.join(sizes, "doc_id").filter(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share))).select("doc_id", "key")


def strip_furniture(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) without those whose key is listed for their document."""
    keyed = lines.withColumn("key", tx.digit_key(F.regexp_replace("line", "^\\s+|\\s+$", "")))
    return keyed.join(keys, ["doc_id", "key"], "left_anti").drop("key")


def split_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def join_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text) of lines in their order."""
    packed = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return packed.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def join_broken_lines(lines: DataFrame) -> DataFrame:
    """Join a line to the one before when it visibly goes on with its sentence.

    It begins with a small letter, neither is a heading or list item, and the one before is
    not empty and does not end a sentence.  Only the raw neighbour decides: a joined line is
    never a heading or an item.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    cut = lines.withColumn("line", F.regexp_replace("line", "^\\s+|\\s+$", "")).withColumn("before", F.lag("line").over(w))
    goes_on = (
        (F.coalesce("before", F.lit("")) != "")
        & F.col("line").rlike("^\\p{Ll}")
        & ~F.col("before").rlike(ENDS)
        & ~F.col("before").startswith("#")
        & ~F.col("before").rlike(LIST_ITEM)
        & ~F.col("line").rlike(LIST_ITEM)
    )
    island = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w)
    grouped = cut.withColumn("island", island).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return grouped.select("doc_id", F.col("l")[0]["line_no"].alias("line_no"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("line"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, word, n): words of three letters or more in lower case, and the calendar once more."""
    words = F.transform(F.filter(F.regexp_extract_all(text_col, F.lit("[\\p{L}\\p{Nl}\\p{No}]+"), F.lit(0)), lambda w: F.char_length(w) >= 3), F.lower)
    seed = F.array(*map(F.lit, CALENDAR))
    return docs.select("doc_id", F.explode(F.concat(F.coalesce(words, F.array().cast("array<string>")), seed)).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def mend_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Join two neighbouring pieces of a line when the whole is a word of the document and not both pieces are.

    Of overlapping joins the left one is made.  A document's lines and its words meet once, as one row each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for held, once, often in zip(frame["lines"], frame["once"], frame["often"], strict=True):
                known = dict.fromkeys(() if once is None else once, 1) | dict.fromkeys(() if often is None else often, 2)
                made.append([None if line is None else _mended(line, known) for line in held])
            yield frame[["doc_id", "numbers"]].assign(lines=made)

    packed = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l")).select("doc_id", F.col("l.line_no").alias("numbers"), F.col("l.line").alias("lines"))
    of = lambda cond: F.collect_list(F.when(cond, F.col("word")))
    held = words.filter("n >= 1").groupBy("doc_id").agg(of(F.col("n") == 1).alias("once"), of(F.col("n") >= 2).alias("often"))
    done = packed.join(held, "doc_id", "left").mapInPandas(run, packed.schema)
    return done.select("doc_id", F.inline(F.arrays_zip("numbers", "lines"))).toDF("doc_id", "line_no", "line")


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(tx.BLANKS))


def furniture_keys(text: Column, share: float = 0.04) -> Column:
    """Keys of lines that recur at the edges of a document's pages, as ``repeated_lines`` has them, without leaving the row."""
    numbers = F.regexp_extract_all(text, F.lit("(?m)^## p\\. (\\d+)$"), F.lit(1))
    parts = F.slice(F.split(text, PAGE_MARK, -1), F.lit(2), F.greatest(F.size(numbers), F.lit(0)))
    filled = lambda body: F.filter(F.transform(F.split(body, "\n"), _trimmed), lambda x: x != "")
    ends = lambda ls: F.when(F.size(ls) <= 5, ls).otherwise(F.concat(F.slice(ls, 1, 2), F.slice(ls, -3, 3)))
    edges = F.zip_with(numbers, parts, lambda no, body: F.transform(F.array_distinct(F.transform(F.array(filled(body)), ends)[0]), lambda x: F.struct(no.cast("int").alias("no"), x.alias("line"))))
    fit = F.filter(F.array_distinct(F.flatten(edges)), lambda e: ~e["line"].startswith("|") & e["line"].rlike("\\p{Nd}") & F.char_length(e["line"]).between(3, 120))
    pages = F.size(F.array_distinct(F.transform(numbers, lambda x: x.cast("int"))))
    least = F.greatest(F.lit(3), F.floor(pages * share).cast("int"))
    # in sorted order a key that occurs so often meets itself so many places on
    often = lambda keys: F.array_distinct(F.filter(keys, lambda k, i: F.coalesce(F.get(keys, i + least - 1) == k, F.lit(False))))
    keys = F.transform(F.array(F.array_sort(F.transform(fit, lambda e: tx.digit_key(e["line"])))), often)[0]
    return F.when(pages >= 3, keys).otherwise(F.array().cast("array<string>"))


def joined_lines(lines: Column) -> Column:
    """Lines put together as ``join_broken_lines`` does, as one text."""
    trimmed = F.transform(lines, _trimmed)
    open_end = lambda x: (x != "") & ~x.rlike(ENDS) & ~x.startswith("#") & ~x.rlike(LIST_ITEM)
    goes_on = lambda ls, x, i: x.rlike("^\\p{Ll}") & ~x.rlike(LIST_ITEM) & F.coalesce(open_end(F.get(ls, i - 1)), F.lit(False))
    glued = lambda ls: F.transform(ls, lambda x, i: F.concat(F.when(i == 0, "").when(goes_on(ls, x, i), " ").otherwise("\n"), x))
    return F.array_join(F.transform(F.array(trimmed), glued)[0], "")


#: Runs of letters, as ``vocabulary`` has them, with what stands between.
_PIECES = re.compile(r"([^\W\d_]+)")


def _counts(tokens: list[str], low: list[str]) -> Counter:
    """How often each word stands among runs of letters, as ``vocabulary`` has it; words under three letters don't matter."""
    known = Counter(low) if sum(map(len, tokens)) == sum(map(len, low)) else Counter(w for t, w in zip(tokens, low, strict=True) if len(t) >= 3)
    known.update(CALENDAR)
    return known


def _mended(text: str, known: Mapping[str, int] | None = None) -> str:
    """A text with its split words joined by a vocabulary, or by its own words."""
    parts = _PIECES.split(text)
    tokens, gaps = parts[1::2], parts[2::2]
    low = list(map(str.lower, tokens))
    if known is None:
        known = _counts(tokens, low)
    sure = lambda w: (len(w) >= 3 and known.get(w, 0) >= 2) or w in _GRAMMAR
    last = -2
    for i in [i for i, whole in enumerate(map(add, low, low[1:])) if whole in known]:  # few are
        if gaps[i] == " " and i != last + 1 and len(low[i]) + len(low[i + 1]) >= 4 and not (sure(low[i]) and sure(low[i + 1])):
            parts[2 * i + 2], last = "", i
    return "".join(parts) if last >= 0 else text


def mended(text: str, by: str | None = None) -> str:
    """A text with its split words joined, the words of ``by``, or its own, being the vocabulary; see ``mend_words``."""
    if by is None:
        return _mended(text)
    tokens = _PIECES.findall(by)
    return _mended(text, _counts(tokens, list(map(str.lower, tokens))))


_GRAMMAR = frozenset(GRAMMAR)


def mend_texts(docs: DataFrame, by: str | None = None) -> DataFrame:
    """(doc_id, text) with split words joined, each text by its own vocabulary or by that of the column ``by``; whole batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            others = frame[by] if by else [None] * len(frame)
            made = [None if text is None else mended(text, other) for text, other in zip(frame["text"], others, strict=True)]
            yield frame[["doc_id"]].assign(text=pd.Series(made, index=frame.index, dtype=object))

    kept = docs.select("doc_id", "text", *([by] if by else []))
    return kept.mapInPandas(run, docs.select("doc_id", "text").schema)


def clean_corpus(docs: DataFrame) -> DataFrame:
    """(doc_id, text) cleaned: hyphens, page furniture, broken lines, split words, elisions, normal form.

    A document is its own world here, so all of it stays in its row: no explode, no shuffle.
    """
    text = tx.dehyphenate(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("keys", furniture_keys(F.col("text")))
    lines = F.split("text", "\n", -1)
    kept = F.when(F.size("keys") > 0, F.filter(lines, lambda x: ~F.array_contains("keys", tx.digit_key(_trimmed(x))))).otherwise(lines)
    whole = mend_texts(keyed.select("doc_id", joined_lines(kept).alias("text")))
    return whole.select("doc_id", tx.normalise_text(tx.mend_elisions(F.col("text"))).alias("text"))


def apply_word_plan(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Replace whole blank-separated tokens by their repaired form (doc_id, word, fixed); layout stays."""
    flat = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("i", "word")).join(plan, ["doc_id", "word"], "left")
    packed = flat.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("fixed", "word").alias("w")))).alias("p"))
    return packed.select("doc_id", "line_no", F.array_join(F.transform("p", lambda x: x["w"]), " ").alias("line"))
