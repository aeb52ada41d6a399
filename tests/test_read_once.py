"""Steps behind several branches of a query run once."""

import pytest
from pyspark.sql import functions as F

from folioflow import catalog
from folioflow.operators import encoding, layout


def test_column_template_reads_its_pages_once(spark, tmp_path, monkeypatch):
    """Each branch placed all words and searched all pages again."""
    # documents of one page, of three pages in two columns, without words
    texts = ["mot " * 30, "mot " * 1300, "", None, "a " * 1000]
    spark.createDataFrame([(i, t, "fr", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.sparkContext.accumulator(0)
    rows = layout.page_rows

    def counted(*args):
        def note(frames):
            for frame in frames:
                read.add(len(frame))
                yield frame

        made = rows(*args)
        return made.mapInPandas(note, made.schema)

    monkeypatch.setattr(layout, "page_rows", counted)
    found = catalog.queries()["a18_column_template"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["rank"]) for r in found} == {(1, 0), (4, 0)}
    assert read.value == 1 + 3 + 3


@pytest.mark.parametrize("step", ["tables", "plan"])
def test_words_are_read_once_whatever_their_documents(spark, monkeypatch, step):
    """Each document had all readings of its words made and judged again."""
    held = [f"m{a}t{b}" for a in "éèêàùç" for b in "Žšœÿ‰"]
    words = spark.createDataFrame([(d, f, w) for d in range(40) for f in ("F1", "F2") for w in held], "doc_id int, font string, text string")
    tables = spark.createDataFrame([(d, f, 0) for d in range(40) for f in ("F1", "F2")], "doc_id int, font string, candidate int")
    calls = spark.sparkContext.accumulator(0)
    plain = encoding.repaired

    def counted(text, candidate):
        @F.udf("string")
        def same(t):
            calls.add(1)
            return t

        return same(plain(text, candidate))

    monkeypatch.setattr(encoding, "repaired", counted)
    (encoding.choose_font_tables(words) if step == "tables" else encoding.word_plan(words, tables)).collect()
    assert 0 < calls.value < 4 * len(encoding.CANDIDATES) * len(held)
