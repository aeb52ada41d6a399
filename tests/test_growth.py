"""Jobs whose cost has to follow the input: no shuffle of single words, and the same rows as the plain path."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow import catalog
from folioflow.operators import cleaning, layout
from folioflow.plans import registered_layout

DIR = Path("/root/testdata/sf0.001")


def shuffles(df) -> int:
    """Exchanges in the plan as it stands before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_mending_by_another_text_equals_the_join_and_stays_in_the_row(spark):
    rows = [(1, "un c hat noir\nle chat c hat c h at", "le chat, le chat noir"), (2, "jan vier ja nvier", ""), (3, "", "x"), (4, "ca fe ca fe", "cafe cafe ca ca fe fe")]
    docs = spark.createDataFrame([*rows, (5, None, "mot")], "doc_id int, text string, by string")
    got = {tuple(r) for r in cleaning.split_lines(cleaning.mend_texts(docs, by="by")).collect()}
    words = cleaning.vocabulary(docs.select("doc_id", F.col("by").alias("text")))
    assert got == {tuple(r) for r in cleaning.mend_words(cleaning.split_lines(docs), words).collect()}
    assert got == {(1, 0, "un chat noir"), (1, 1, "le chat chat c h at"), (2, 0, "janvier janvier"), (3, 0, ""), (4, 0, "cafe cafe")}
    if DIR.exists():
        assert shuffles(catalog.queries()["j7_mend_words"](spark, str(DIR))) == 0


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def placed(spark):
    """Words that are out of order, lines whose tops differ a little, two columns, wide words as shapes."""
    rows = []
    for doc in (1, 2, 3):
        for page in (0, 1, 2):
            for n in range(60 if doc < 3 else 7):
                line, slot = divmod(n, 6)
                x0 = slot * 40.0 + (90.0 if slot >= 3 else 0.0) + (page * 7 if line % 4 == 0 else 0)
                rows.append((doc, page, n, f"w{n}" * (1 + n % 3), x0, x0 + 10 + n % 25, line * 14.0 + (n % 2) * 0.5, line * 14.0 + 9 + n % 3))
    return spark.createDataFrame(rows[::-1], "doc_id int, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")


def test_layout_in_page_rows_equals_layout_of_single_words(spark):
    words = placed(spark).cache()
    metrics, sizes = layout.layout_metrics(words), registered_layout.sizes(words)
    lined = layout.visual_lines(words, metrics).cache()
    pages = layout.page_rows(layout.pack_documents(words)).cache()
    names = ["doc_id", "page_no", "line_no", "text", "x0", "x1", "top", "bottom"]
    assert rows(pages.select("doc_id", "line_height", "space_width", "line_gap").distinct()) == rows(metrics)
    assert rows(layout.page_lines(pages).select(*names)) == rows(layout.line_texts(lined).select(*names))
    assert rows(layout.page_gutters(pages, 700.0)) == rows(layout.gutters(lined, metrics, sizes)) != []
    assert rows(layout.page_boundaries(pages, 700.0)) == rows(layout.clustered_boundaries(lined, sizes)) != []
    assert rows(layout.page_texts(pages, [(0.0, 270.0), (270.0, 560.0)])) == rows(layout.render_columns(words, registered_layout._halves(words), metrics)) != []
    kind = F.when(F.char_length("text") > 8, "image").when(F.char_length("text") > 5, "rect").otherwise("curve")
    shapes = words.filter("word_no % 9 < 4").withColumn("kind", kind).join(sizes, ["doc_id", "page_no"])
    drawn = F.transform(F.filter(F.arrays_zip("word_no", "text", "x0", "top", "x1", "bottom"), lambda w: w["word_no"] % 9 < 4), lambda w: F.struct(F.when(F.char_length(w["text"]) > 8, "image").when(F.char_length(w["text"]) > 5, "rect").otherwise("curve").alias("kind"), *(w[c].alias(c) for c in ("x0", "top", "x1", "bottom"))))
    for per_page in (12, 1):
        assert rows(layout.page_regions(pages.withColumn("shapes", drawn), (700.0, 800.0), gap=6.0, least=(10.0, 20.0), few_words=4, per_page=per_page)) == rows(layout.figure_regions(shapes, words, gap=6.0, least=(10.0, 20.0), few_words=4, per_page=per_page)) != []


@pytest.mark.parametrize("name", ["n7_visual_lines", "a16_gutters", "a17_clustered_boundaries", "x8_render_columns", "a12_figure_regions"])
def test_no_word_is_shuffled(spark, name):
    if DIR.exists():
        assert shuffles(catalog.queries()[name](spark, str(DIR))) == 0


def test_plain_words_are_judged_as_by_the_long_patterns(spark):
    from folioflow.operators import encoding, quality

    words = ["a", "b", "Ab", "xyz", "mot", "Mot,", "MOT", "mOt", "rythm", "Xyz.", "x" * 31, "a" * 30, "l'eau", "ab.cd", "été", "²", "bc!", "Q?"]
    df = spark.createDataFrame([(w,) for w in words], "t string").filter(F.col("t").rlike(encoding.PLAIN_WORD))
    long = df.select(F.regexp_count("t", F.lit(quality.LETTER + "+")), F.regexp_count("t", F.lit(quality.ANY_LETTER + "+")), F.regexp_count("t", F.lit(f"(?<!{quality.LETTER})(?:{quality.WORD})(?!{quality.LETTER})")), "t").collect()
    short = {r[0]: int(r[1]) for r in df.select("t", F.col("t").rlike("[AEIOUYaeiouy]|^[A-Za-z]{1,2}[.,;:!?]?$")).collect()}
    assert all((r[0], r[1], r[2]) == (1, 1, short[r[3]]) for r in long) and {"Ab", "xyz", "Xyz.", "bc!", "Mot,"} <= set(short)


def test_lines_keep_their_starts_and_stay_in_the_row(spark):
    from folioflow.operators import quality

    texts = ["", "\n", "é\n\nab", "\n".join("x" * (i % 7) for i in range(700)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = quality.lines(docs, "doc_id")
    want = []
    for i, t in enumerate(texts):
        at = 0
        for n, line in enumerate((t or "").split("\n")):
            want.append((i, n, line, at))
            at += len(line) + 1
    assert rows(got) == sorted(want) and shuffles(got) == 0
