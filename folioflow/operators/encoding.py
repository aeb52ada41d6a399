"""Repair of misread encodings, font by font, and the writing system of a document."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved
from . import quality

#: (how bytes were read, how they should have been) of each candidate repair.
CANDIDATES = (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "latin-1"), ("latin-1", "cp1252"))
#: Least words of a font to judge it, least gain over leaving it alone, least fitness of a readable font.
SAMPLE, MARGIN, FLOOR = 20, 0.05, 0.80
#: What a word holds that some reading changes.
CHANGEABLE = "[^\\x00-\\x7f]|^\\(cid:"
#: One word of plain letters, all but the first small, maybe with a sign behind it.
PLAIN_WORD = "^[A-Z]?[a-z]{1,29}[.,;:!?]?$"
#: First and last code points of writing systems.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF),
    ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("ethiopic", 0x1200, 0x137F),
    ("cjk", 0x3040, 0x30FF), ("cjk", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def translation(seen: str, real: str) -> tuple[str, str]:
    """``translate`` strings that turn bytes read as ``seen`` into what they are in ``real``; never into a control character."""
    source, target = [], []
    for byte in range(0x80, 0x100):
        try:
            a, b = bytes([byte]).decode(seen), bytes([byte]).decode(real)
        except UnicodeDecodeError:
            continue
        if a != b and unicodedata.category(b) not in ("Cc", "Cf"):
            source.append(a)
            target.append(b)
    return "".join(source), "".join(target)


def repaired(text: Column, candidate: tuple[str, str]) -> Column:
    """The text in a candidate's reading; a (cid:N) mark that is a whole word is read as that byte."""
    seen, real = candidate
    byte = F.regexp_extract(text, "^\\(cid:(\\d+)\\)$", 1).try_cast("int")
    table = F.create_map(*(x for b in range(0x80, 0x100) for x in (F.lit(b), F.lit(bytes([b]).decode(real, "replace")))))
    plain = F.translate(text, *translation(seen, real))
    return F.when(byte.between(0x80, 0xFF), F.get(F.array(F.element_at(table, byte)), F.lit(0))).otherwise(plain)


def _spread(rows: DataFrame) -> DataFrame:
    """Few bytes that take much time, over all cores: the adaptive size counts bytes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def choose_font_tables(words: DataFrame) -> DataFrame:
    """(doc_id, font, candidate, label, readable): the candidate whose reading makes a font most plausible, -1 for none.

    Fitness is the share of plausible words over the factor by which words fall apart.
    """
    # one row a distinct word; a candidate counts only by the words that it changes
    once = words.groupBy("doc_id", "font", "text").agg(F.count(F.lit(1)).alias("k"))
    # most words are plain ones, whose counts two short patterns tell
    plain_one = lambda c, yes, no: F.when(c.rlike(PLAIN_WORD), yes).otherwise(F.regexp_count(c, F.lit(no)))
    tokens = lambda c: plain_one(c, F.lit(1), quality.LETTER + "+")
    good = lambda c: plain_one(c, c.rlike("[AEIOUYaeiouy]|^[A-Za-z]{1,2}[.,;:!?]?$").cast("int"), f"(?<!{quality.LETTER})(?:{quality.WORD})(?!{quality.LETTER})")
    pieces = lambda c: plain_one(c, F.lit(1), quality.ANY_LETTER + "+")
    judged = lambda c: (tokens(c).alias("n"), good(c).alias("good"), pieces(c).alias("after"))
    # read by two branches: each word is judged once
    own = once.select("doc_id", "font", "k", *judged(F.col("text"))).groupBy("doc_id", "font")
    own = saved(own.agg(F.sum("k").alias("words"), *(F.sum(F.col(c) * F.col("k")).alias(c) for c in ("n", "good", "after"))).withColumn("before", F.col("after")), "fonts")
    reads = F.array(*(F.struct(F.lit(i).alias("candidate"), repaired(F.col("text"), c).alias("read")) for i, c in enumerate(CANDIDATES)))
    may = F.col("text").rlike(CHANGEABLE)
    # a word reads alike in all documents and fonts: its readings are judged once, and meet its rows
    plain = _spread(words.filter(may).select("text").distinct()).select("text", *judged(F.col("text")))
    changed = plain.select("*", F.explode(F.filter(reads, lambda v: v["read"] != F.col("text"))).alias("v"))
    moves = changed.select("text", "v.candidate", *((c - F.col(name)).alias(f"d_{name}") for c, name in zip(judged(F.col("v.read")), ("n", "good", "after"), strict=True)))
    delta = once.filter(may).join(moves, "text").groupBy("doc_id", "font", "candidate").agg(*(F.sum(F.col(f"d_{c}") * F.col("k")).alias(f"d_{c}") for c in ("n", "good", "after")))
    moved = own.join(delta, ["doc_id", "font"]).select("doc_id", "font", "candidate", "words", *((F.col(c) + F.col(f"d_{c}")).alias(c) for c in ("n", "good", "after")), "before")
    sums = own.withColumn("candidate", F.lit(-1)).unionByName(moved)
    split = F.when(F.col("before") > 0, F.greatest(F.lit(1.0), F.col("after") / F.col("before"))).otherwise(1.0)
    fit = F.when(F.col("n") > 0, F.round(F.col("good") / F.col("n"), 4)).otherwise(0.0) / split
    scored = sums.withColumn("fit", fit).withColumn("own", F.max(F.when(F.col("candidate") == -1, fit)).over(Window.partitionBy("doc_id", "font")))
    able = scored.filter((F.col("candidate") == -1) | (F.col("fit") >= F.col("own") + MARGIN))
    best = able.groupBy("doc_id", "font").agg(F.max(F.struct("fit", (-F.col("candidate")).alias("order"), "candidate")).alias("b"), F.max("words").alias("words"), F.max("own").alias("own"))
    fixed = F.contains("font", F.lit("Symbol"))
    few = F.col("words") < SAMPLE
    names = F.array(*(F.lit(f"{b} read as {a}") for a, b in CANDIDATES))
    candidate = F.when(fixed | few, -1).otherwise(F.col("b.candidate"))
    label = F.when(fixed, "symbol").when(few, "ignored").when(candidate < 0, "none").otherwise(F.get(names, candidate))
    readable = fixed | few | (F.when(candidate < 0, F.col("own")).otherwise(F.col("b.fit")) >= FLOOR)
    return best.select("doc_id", "font", candidate.alias("candidate"), label.alias("label"), readable.alias("readable"))


def reads_well(word: Column) -> Column:
    tokens = F.regexp_extract_all(word, F.lit(quality.LETTER + "+"), F.lit(0))
    return (F.size(tokens) > 0) & F.forall(tokens, quality.plausible) & ~word.rlike("\\(cid:\\d+\\)")


def rescue(word: Column) -> Column:
    """A word that does not read well, if all candidates that make it do agree on one reading; else the word."""
    reads = F.array_distinct(F.filter(F.array(*(F.translate(word, *translation(*c)) for c in CANDIDATES)), reads_well))
    return F.when(~reads_well(word) & (F.size(reads) == 1), F.get(reads, F.lit(0))).otherwise(word)


def word_plan(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, word, fixed): words that every occurrence, in whatever font, repairs to the same other word."""
    chosen = reduce(lambda w, ic: w.when(F.col("candidate") == ic[0], repaired(F.col("text"), ic[1])), enumerate(CANDIDATES), F).otherwise(F.col("text"))
    # all readings leave other words as they are, and equal words of a font are read alike
    once = words.filter(F.col("text").rlike(CHANGEABLE)).select("doc_id", "font", "text").distinct()
    read = once.join(tables.select("doc_id", "font", "candidate"), ["doc_id", "font"], "left").withColumn("candidate", F.coalesce("candidate", F.lit(-1)))
    # a word in a reading is repaired alike in all documents: once, and met by its rows; a filter here would go down to them
    fixed = _spread(read.select("text", "candidate").distinct()).select("text", "candidate", chosen.alias("read")).select("text", "candidate", rescue(F.col("read")).alias("fixed"))
    each = read.join(fixed, ["text", "candidate"]).select("doc_id", F.col("text").alias("word"), "fixed")
    agreed = each.groupBy("doc_id", "word").agg(F.min("fixed").alias("fixed"), F.max("fixed").alias("other"))
    return agreed.filter("fixed = other and fixed != word").select("doc_id", "word", "fixed")


def script_of(code_point: Column) -> Column:
    """The writing system of a code point, null outside the listed ranges."""
    return F.coalesce(*(F.when(code_point.between(a, b), F.lit(n)) for n, a, b in SCRIPTS))


def dominant_script(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_col: str | None = None, least: float = 0.6, foreign: float = 0.3) -> DataFrame:
    """(id, script): the system of ``least`` or more of the placed letters, else ``mixed``; ``unknown`` without any.

    Rows are pieces of documents, such as the text of one font.  With ``trusted_col`` the
    pieces that are trusted decide; where a document has no letter in such a piece, a system
    other than latin that has ``foreign`` of all its letters is taken, else ``unknown``.
    Letters are counted within each row, and only the counts meet.
    """
    systems = {n: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for m, a, b in SCRIPTS if m == n) for n, _, _ in SCRIPTS}
    trusted = F.coalesce(F.col(trusted_col), F.lit(False)) if trusted_col else F.lit(True)
    letters = F.regexp_replace(F.coalesce(text_col, F.lit("")), "[^\\p{L}]", "")
    counted = docs.select(id_col, trusted.alias("t"), letters.alias("l")).select(id_col, "t", *(F.regexp_count("l", F.lit(f"[{p}]")).alias(n) for n, p in systems.items()))
    sums = counted.groupBy(id_col).agg(*(F.sum(F.when(F.col("t"), F.col(n)).otherwise(0)).alias(f"t_{n}") for n in systems), *(F.sum(n).alias(n) for n in systems))

    def top(prefix: str, names) -> Column:
        return F.array_max(F.array(*(F.struct(F.col(f"{prefix}{n}").alias("n"), F.lit(n).alias("script")) for n in names)))

    total = lambda prefix: sum((F.col(f"{prefix}{n}") for n in systems), F.lit(0))
    best, other = top("t_", systems), top("", [n for n in systems if n != "latin"])
    script = F.when(total("t_") > 0, F.when(best["n"] >= least * total("t_"), best["script"]).otherwise("mixed")).when(other["n"] >= F.greatest(F.lit(1), foreign * total("")), other["script"]).otherwise("unknown")
    return sums.select(id_col, script.alias("script"))


def decide_font_encodings(codes: DataFrame, fits: DataFrame, gain: float = 0.15, lead: float = 0.10, least: int = 8, large: int = 100) -> DataFrame:
    """(doc_id, font, codec): a codec for each font from its code counts, or none.

    ``codes``: doc_id, font, code, n, declares (its object brings a table); ``fits``: codec,
    code, worth (1 where the codec makes a usual character of the code), the codec
    ``identity`` among them.  Fonts of which all objects declare a table are trusted and left
    alone.  The best codec must beat leaving it alone by ``gain`` and the next by ``lead``,
    on ``least`` samples; under ``large`` samples a font only follows a codec that a larger
    font of its document has elected.
    """
    sizes = codes.groupBy("doc_id", "font").agg(F.sum("n").alias("samples"), F.bool_and("declares").alias("trusted"))
    # the table of codecs is a constant of some thousand rows
    share = codes.join(F.broadcast(fits), "code").groupBy("doc_id", "font", "codec").agg(F.sum(F.col("n") * F.col("worth")).alias("w"))
    share = share.join(sizes, ["doc_id", "font"]).filter(~F.col("trusted") & (F.col("samples") >= least)).withColumn("s", F.col("w") / F.col("samples"))
    w = Window.partitionBy("doc_id", "font")
    own = F.max(F.when(F.col("codec") == "identity", F.col("s"))).over(w)
    ranked = share.withColumn("own", F.coalesce(own, F.lit(0.0))).filter("codec != 'identity'").withColumn("k", F.row_number().over(w.orderBy(F.desc("s"), "codec"))).withColumn("next", F.lead("s").over(w.orderBy(F.desc("s"), "codec")))
    good = ranked.filter((F.col("k") == 1) & (F.col("s") >= F.col("own") + gain) & (F.col("s") >= F.coalesce("next", F.lit(0.0)) + lead))
    elected = good.filter(F.col("samples") >= large).select("doc_id", "codec").distinct()
    return good.filter(F.col("samples") >= large).unionByName(good.filter(F.col("samples") < large).join(elected, ["doc_id", "codec"], "left_semi").select(*good.columns)).select("doc_id", "font", "codec")
