"""Text quality: scores, doubtful passages with their offsets, section confidence.

Offsets are code points, ends exclusive.  Null texts are treated as empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charclasses
from ..functions import text as tx

#: Superscripts and subscripts, which are digits and no letters here.
SCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ₀₁₂₃₄₅₆₇₈₉₊₋"
#: The expected repertoire beside Latin letters and numbers.
PUNCTUATION = " \t\n\r.,;:!?…'\"«»‘’“”()[]{}<>/\\|-–—+±×÷=≠≤≥%‰°#&*@$€£§©®™_^~`•·◦"
SYMBOLS = "πΠΣσΔδθλμαβγΩω∈∉⊂⊄∩∪∅∀∃∞√∫≈≡→←↔⇒⇔⊥∥∠′″ℓℝℕℤℚℂ↦∘⋅∑∏∂∇≃≅∝⟨⟩" + SCRIPTS
#: Characters of a misread encoding, and symbols of formulas.
MOJIBAKE = "ŽÕƒÏ™šÐ¥ˆ‰‹›¡¢¤¦¨ª¬¯¶¸ºËÍ"
MATH = "≤≥≠≈±×÷√∑∏∫∈∉⊂⊆∩∪∧∨⇔⇒→←↔∞∀∃⊥∥∠°αβγδθλμπσωΩΔΣΠ"
ACCENTED_CAPITALS = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
#: French words of one or two letters.
SHORT_WORDS = (
    "a", "à", "y", "au", "ai", "as", "ce", "de", "du", "en", "es", "et", "eu", "il", "je", "la", "le", "ma", "me",
    "ne", "ni", "on", "ou", "où", "sa", "se", "si", "ta", "te", "tu", "un", "va", "vu",
)
#: What an issue costs a section's confidence.
WEIGHTS = {"FORMULA": 0.20, "ENCODING": 0.10, "UNREADABLE": 0.10, "OCR_NOISE": 0.08, "THIN": 0.30, "DUPLICATE_CELL": 0.15}

#: Keeps a value that arithmetic left just below a half from being rounded down.
HALF = 1e-9

LETTER = f"[\\p{{L}}\\p{{Nl}}\\p{{No}}&&[^{SCRIPTS}]]"
ANY_LETTER = "[\\p{L}\\p{Nl}\\p{No}]"
_LOW, _UP = tx.FRENCH, tx.FRENCH.upper()


def _charclass(chars: str) -> str:
    return "".join(f"\\{c}" if c in "\\[]^-&~|{}()" else c for c in chars)


def plausible(word: Column) -> Column:
    """A word of the language: its alphabet, a vowel, no capital inside unless all are; one or two letters always."""
    return word.rlike(f"^(?:{WORD})$")


#: A plausible word: one or two letters, a word in small letters or with a capital first, or one all in capitals.
_VOWELS = tx.VOWELS + tx.VOWELS.upper()
_OTHERS = "".join(c for c in _LOW + _UP if c not in _VOWELS)
WORD = f"[{_LOW}{_UP}]{{1,2}}|(?=[{_OTHERS}]{{0,29}}[{_VOWELS}])(?:[{_LOW}{_UP}][{_LOW}]{{2,29}}|[{_UP}]{{3,30}})"


def assess(df: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """Add ``quality``: score, cid_markers, out_of_repertoire, word_plausibility, characters.  No explode, no shuffle.

    Words are runs of letters; all counts of a text come from one pass over its characters.
    """
    text = F.coalesce(text_col, F.lit(""))
    names = [f"_{n}{i}" for i, n in enumerate(("made", "cid", "n", "good", "odd"))]
    made, cid, n, good, odd = names
    # superscripts and subscripts are no letters
    counted = df.withColumn(made, charclasses.word_counts(text, PUNCTUATION + SYMBOLS, SCRIPTS)).withColumns({
        cid: F.col(made)["cid"],
        n: F.col(made)["words"],
        good: F.col(made)["good"],
        odd: F.col(made)["odd"] / F.greatest(F.col(made)["length"], F.lit(1)),
    })
    share = F.when(F.col(n) > 0, F.col(good) / F.col(n)).otherwise(0.0)
    penalty = F.least(F.lit(1.0), F.col(cid) / F.greatest(F.lit(1), F.col(n)) * 10)
    raw = share * 0.7 + (F.lit(1.0) - F.least(F.lit(1.0), F.col(odd) * 20)) * 0.3 - penalty * 0.3
    score = F.when(F.char_length(text) == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) + HALF, 4))
    told = F.struct(
        score.alias("score"),
        F.col(cid).cast("int").alias("cid_markers"),
        F.round(F.col(odd) + HALF, 5).alias("out_of_repertoire"),
        F.round(share + HALF, 4).alias("word_plausibility"),
        F.char_length(text).alias("characters"),
    )
    return counted.withColumn(out, told).drop(*names)


def corrupted_pages(pages: DataFrame, floor: float = 0.80) -> DataFrame:
    """(doc_id, pages): numbers of pages with a cid marker or too few plausible words; blank pages never."""
    filled = assess(pages.filter(F.coalesce(F.trim("text"), F.lit("")).rlike("\\S")))
    bad = filled.filter((F.col("quality.cid_markers") > 0) | (F.col("quality.word_plausibility") < floor))
    return bad.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_no")).alias("pages"))


def lines(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line_no, line, start) of every line; a text is cut in its row, without a shuffle."""

    def placed(cut: Column) -> Column:
        ends = tx.running_sum(F.transform(cut, lambda x: F.char_length(x) + 1))
        return F.zip_with(cut, ends, lambda x, end: F.struct(x.alias("line"), (end - F.char_length(x) - 1).alias("start")))

    # bound as the item of an array, so that the text is cut once
    made = F.transform(F.array(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)), placed)[0]
    return df.select(id_col, F.posexplode(made).alias("line_no", "l")).select(id_col, "line_no", "l.line", "l.start")


def _issue(kind, start, end, excerpt) -> list[Column]:
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.alias("start"), end.alias("end"), excerpt.alias("excerpt")]


def encoding_issues(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Characters of a misread encoding, and accented capitals between a letter and a small letter; one report a position."""
    pattern = f"[{MOJIBAKE}]|(?<={ANY_LETTER})[{ACCENTED_CAPITALS}](?=[a-zà-öø-ÿ])"
    hit = df.select(id_col, text_col, F.explode(tx.spans(F.col(text_col), pattern)).alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    broad = F.col("s.match").rlike(f"^[{MOJIBAKE}]")
    low = F.greatest(start - 20, F.lit(0))
    return hit.select(id_col, *_issue("ENCODING", start, end, F.substr(text_col, low + 1, F.when(broad, start + 20).otherwise(end + 20) - low)))


def ocr_runs(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Three or more one- or two-letter pieces in a row that are no short words; a formula if the surroundings look like one."""
    piece = f"(?!(?iu:{'|'.join(SHORT_WORDS)})(?!\\S)){ANY_LETTER}{{1,2}}(?!\\S)"
    # possessive: nothing follows the pieces, and without it the pattern goes a call deeper with each, past the stack in long runs
    hit = df.select(id_col, text_col, F.explode(tx.spans(F.col(text_col), f"(?<!\\S){piece}(?:\\s+{piece}){{2,}}+")).alias("s"))
    near = tx.around(F.col(text_col), F.col("s.start"), F.col("s.end"), 15)
    mathy = near.rlike(f"[{MATH}\\p{{Nd}}²³¹=+^\\x{{1D400}}-\\x{{1D7FF}}]")
    return hit.select(id_col, *_issue(F.when(mathy, "FORMULA").otherwise("OCR_NOISE"), F.col("s.start"), F.col("s.end"), F.col("s.match")))


def unreadable_lines(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Lines of four or more words of over two letters, fewer than half of them plausible."""
    stripped = F.regexp_replace("line", "^\\s+|\\s+$", "")
    words = F.filter(F.regexp_extract_all(stripped, F.lit(ANY_LETTER + "+"), F.lit(0)), lambda w: F.char_length(w) > 2)
    good = F.size(F.filter("words", lambda w: w.rlike(f"^[{_LOW}{_UP}]+$") & w.rlike(f"[{tx.VOWELS}{tx.VOWELS.upper()}]")))
    cut = lines(df, id_col, text_col).withColumn("stripped", stripped).withColumn("words", words)
    bad = cut.filter((F.size("words") >= 4) & (good / F.size("words") < 0.5))
    return bad.select(id_col, *_issue("UNREADABLE", F.col("start"), F.col("start") + F.char_length("line"), F.substring("stripped", 1, 80)))


def formula_issues(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Operators alone at an edge of the text, and lines of formulas with unbalanced parentheses."""
    # a sign between blanks with nothing but blanks in the three characters before it, or after it
    sign = f"(?<!\\S)(?:(?<!\\S\\s)(?<!\\S\\s\\s)[{MATH}](?!\\S)|[{MATH}](?!\\S)(?!\\s\\S)(?!\\s\\s\\S))"
    hit = df.select(id_col, text_col, F.explode(tx.spans(F.col(text_col), sign)).alias("s"))
    start, end = F.col("s.start"), F.col("s.end")
    alone = hit.select(id_col, *_issue("FORMULA", start, end, tx.around(F.col(text_col), start, end, 30)))
    # fixed value: marks of an enumeration, whose parenthesis closes nothing
    plain = F.regexp_replace("line", "[0-9]+\\)|\\b[a-zA-Z]{1,3}\\)", "")
    opened, closed = F.regexp_count(plain, F.lit("\\(")), F.regexp_count(plain, F.lit("\\)"))
    cut = lines(df, id_col, text_col).filter(plain.rlike(f"[{MATH}]") & (opened != closed))
    stripped = F.regexp_replace("line", "^\\s+|\\s+$", "")
    return alone.unionByName(cut.select(id_col, *_issue("FORMULA", F.col("start"), F.col("start") + F.char_length("line"), F.substring(stripped, 1, 80))))


def duplicate_cells(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Table cells of 40 characters or more that the section already had, all but the first."""
    rows = lines(df, id_col, text_col).filter(F.col("line").startswith("|"))
    cells = rows.select(id_col, "line_no", "line", "start", F.posexplode(F.split("line", "\\|", -1)).alias("cell_no", "cell"))
    cells = cells.withColumn("cell", F.regexp_replace("cell", "^\\s+|\\s+$", "")).filter(F.char_length("cell") >= 40)
    nth = F.row_number().over(Window.partitionBy(id_col, "cell").orderBy("line_no", "cell_no"))
    again = cells.withColumn("nth", nth).filter("nth > 1")
    at = F.col("start") + F.expr("locate(cell, line)") - 1
    return again.select(id_col, *_issue("DUPLICATE_CELL", at, at + F.char_length("cell"), F.substring("cell", 1, 80)))


def thin_sections(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Sections under 25 characters that are no heading."""
    text = F.coalesce(text_col, F.lit(""))
    stripped = F.regexp_replace(text, "^\\s+|\\s+$", "")
    words = F.split(stripped, "\\s+")
    heading = ~F.contains(stripped, F.lit("\n")) & ~stripped.rlike("[.:;,!?]$") & (F.size(words) >= 2) & stripped.rlike("^\\p{Lu}")
    return df.filter((F.char_length(stripped) < 25) & ~heading).select(id_col, *_issue("THIN", F.lit(0), F.char_length(text), F.substring(stripped, 1, 60)))


DETECTORS = (thin_sections, encoding_issues, ocr_runs, unreadable_lines, formula_issues, duplicate_cells)


def issues(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """All issues, repeats included: the confidence counts them before they are made distinct."""
    return reduce(DataFrame.unionByName, (f(df, id_col, text_col) for f in DETECTORS))


def distinct_issues(found: DataFrame, id_col: str) -> DataFrame:
    """One issue for each kind and span."""
    return found.groupBy(id_col, "kind", "start", "end").agg(F.max("excerpt").alias("excerpt"))


def section_confidence(df: DataFrame, found: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, confidence): 1 less the weighted issues per thousand characters, within 0 and 1, three digits."""
    weight = reduce(lambda w, kv: w.when(F.col("kind") == kv[0], kv[1]), WEIGHTS.items(), F).otherwise(0.05)
    cost = found.groupBy(id_col).agg(F.sum(weight).alias("cost"))
    scale = F.greatest(F.lit(1.0), F.char_length(F.coalesce(text_col, F.lit(""))) / 1000)
    kept = df.select(id_col, scale.alias("scale")).join(cost, id_col, "left")
    return kept.select(id_col, F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("cost", F.lit(0.0)) / F.col("scale")), 3).alias("confidence"))


def issue_summary(found: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, n)."""
    return found.groupBy(id_col, "kind").agg(F.count(F.lit(1)).alias("n"))
