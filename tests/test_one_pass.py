"""Passes over whole texts against the operators that take them apart, and character tables against Spark's patterns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import charclasses
from folioflow.functions import text as tx
from folioflow.operators import cleaning, quality


def by_lines(docs):
    """The clean-up composed of operators on lines and words."""
    joined = docs.select("doc_id", tx.dehyphenate(F.coalesce("text", F.lit(""))).alias("text"))
    lines = cleaning.join_broken_lines(cleaning.strip_furniture(cleaning.split_lines(joined), cleaning.repeated_lines(cleaning.split_pages(joined))))
    mended = cleaning.mend_words(lines, cleaning.vocabulary(cleaning.join_lines(lines)))
    whole = cleaning.join_lines(mended).select("doc_id", tx.normalise_text(tx.mend_elisions(F.col("text"))).alias("text"))
    return docs.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def page(rng, no, words):
    lines = [f"Lycée {rng.choice('AB')} 20{rng.randint(10, 12)} - {no}"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(0, 7)):
        line = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(words)
            cut = rng.randint(1, max(1, len(w) - 1))
            line.append(f"{w[:cut]} {w[cut:]}" if rng.random() < 0.25 else w.capitalize() if rng.random() < 0.2 else w)
        lines.append(rng.choice(["", "", "- ", "# ", "  ", "| "]) + rng.choice([" ", "  "]).join(line) + rng.choice(["", ".", " ", "-", ";"]))
    lines += ["", f"page {no} / 9"] if rng.random() < 0.7 else []
    return f"## p. {no}\n\n" + "\n".join(lines)


def test_clean_up_in_the_row_equals_lines_and_words(spark):
    rng = random.Random(1)
    words = ["maison", "école", "élève", "théorème", "le", "la", "de", "est", "été", "été", "aujourd", "hui", "l'", "d'", "octobre", "x2", "ab", "abc"]
    texts = [None, "", "\n\n", "## p. 1\n\nx", "un mot\nsuivi", "d' octobre l' été"]
    texts += ["\n\n".join(page(rng, n + 1, words) for n in range(rng.choice([0, 1, 2, 3, 4, 8]))) + rng.choice(["", "\nfin du do-\ncument\net la suite"]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in cleaning.clean_corpus(docs).collect()}
    assert got == {r["doc_id"]: r["text"] for r in by_lines(docs).collect()}
    assert "Exchange" not in cleaning.clean_corpus(docs)._jdf.queryExecution().executedPlan().toString()
    assert any(t and "Lycée" in t and "Lycée" not in got[i] for i, t in enumerate(texts))


def test_repeated_rows_are_cleaned_alike(spark):
    docs = spark.createDataFrame([(1, "un  mot \n\n\n\nfin"), (1, "un  mot \n\n\n\nfin"), (None, "x")], "doc_id int, text string")
    assert sorted(map(str, (tuple(r) for r in cleaning.clean_corpus(docs).collect()))) == ["(1, 'un  mot\\n\\nfin')"] * 2 + ["(None, 'x')"]


def test_character_classes_equal_patterns(spark):
    """All code points that both know: letters, numbers, Latin, and the alphabet."""
    import unicodedata

    table = charclasses.classes(quality.PUNCTUATION + quality.SYMBOLS, quality.SCRIPTS)
    points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string")
    usual = f"^[{quality._charclass(quality.PUNCTUATION + quality.SYMBOLS)}\\p{{N}}[\\p{{L}}&&\\p{{IsLatin}}&&[^ªº]]]$"
    rows = df.filter(F.col("s").rlike("^(?s).$") & F.col("s").rlike("\\P{Cn}")).select("c", F.col("s").rlike(f"^{quality.LETTER}$").alias("letter"), F.col("s").rlike(usual).alias("usual")).collect()
    wrong = [hex(r["c"]) for r in rows if bool(table[r["c"]] & charclasses.LETTER) != r["letter"] or bool(table[r["c"]] & charclasses.USUAL) != r["usual"]]
    assert len(rows) > 100_000
    assert ",".join(wrong) == ""


def test_counts_equal_patterns(spark, monkeypatch):
    monkeypatch.setattr(charclasses, "SLICE", 64)
    rng = random.Random(2)
    pieces = ["Bonjour", "ÉCOLE", "école", "Été", "bcd", "xyz", "aB", "Ab", "abC", "x²", "été³", "(cid:12)", "(cid:x)", "mot(cid:3)mot", "한국", "ª", "ŒUVRE", "œuvre", "a" * 30, "a" * 31, "b" * 29 + "a", "straße", "Ⅳ", "½", "ﬁn", "\n", "  ", "≤", " 𝒳 ", "é"]
    texts = [None, "", " ", *("".join(rng.choice(pieces) + rng.choice([" ", "", "-", "\t"]) for _ in range(rng.randint(0, 30))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    text = F.coalesce("text", F.lit(""))
    stripped = F.regexp_replace(text, "\\(cid:\\d+\\)", " ")
    worded = F.translate(stripped, quality.SCRIPTS, " " * len(quality.SCRIPTS))
    letter = "[a-zA-Z\\p{L}\\p{Nl}\\p{No}]"
    usual = f"[{quality._charclass(quality.PUNCTUATION + quality.SYMBOLS)}\\p{{N}}[\\p{{L}}&&\\p{{IsLatin}}&&[^ªº]]]++"
    want = df.select(
        "i", F.regexp_count(text, F.lit("\\(cid:\\d+\\)")).alias("cid"), F.char_length(stripped).alias("length"), F.regexp_count(worded, F.lit(f"{letter}++")).alias("words"),
        F.regexp_count(worded, F.lit(f"(?<!{letter})(?:{quality.WORD})(?!{letter})")).alias("good"), F.char_length(F.regexp_replace(stripped, usual, "")).alias("odd"),
    )
    got = df.select("i", charclasses.word_counts(text, quality.PUNCTUATION + quality.SYMBOLS, quality.SCRIPTS).alias("q")).select("i", "q.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_letter_beyond_the_basic_plane_belongs_to_its_word():
    table = charclasses.classes("", "")
    assert charclasses.count_words(["𝒳mot 𝒳 mot"], table)[0, :2].tolist() == [3, 1]


@pytest.mark.parametrize("texts", [[], [""], ["a"], ["", "a b", ""]])
def test_counts_of_few_texts(texts):
    table = charclasses.classes("", "")
    assert charclasses.count_words(texts, table)[:, 0].tolist() == [len(t.split()) for t in texts]
    assert isinstance(charclasses.count_words(texts, table), np.ndarray)
