"""Pages without text, against SQL, and lines that look like page markers."""

import duckdb

from folioflow import catalog
from folioflow.operators import parsing


def rows_of(spark, tmp_path, name: str, texts: list) -> tuple[list, list]:
    """What a query gives for documents of these texts, and what its SQL gives."""
    docs = [(i, t, "fr", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    asked = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in asked.description]
    by = lambda r: tuple(map(str, r))
    want = sorted(asked.fetchall(), key=by)
    got = sorted((tuple(r[c] for c in names) for r in catalog.queries()[name](spark, str(tmp_path)).collect()), key=by)
    return got, want


ODD = ["un mot", None, "", " \n\t ", "123 = 456", ". ; .", "\x0bmot\x0b", "fin   ", "fin\r\n", "debut\n## p. 2\nsuite", "b c d", None, "deux\n\nlignes", "É", "== =="]


def test_pages_without_text_keep_marker_and_marks(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, "c26_figure_marks", ODD)
    assert got == want


def test_marks_stand_below_the_first_marker_only(spark):
    """A line of a text that looks like a marker gets no marks again, however long its number."""
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["## p. 1", "a", "## p. 1", "## p. 99999999999"])], "doc_id long, line_no int, line string")
    marks = spark.createDataFrame([(1, 1, "[FIGURE x]"), (1, 7, "[FIGURE y]")], "doc_id long, page_no int, mark string")
    made = parsing.place_figure_marks(lines, marks).collect()
    assert [r["text"] for r in made] == ["## p. 1\n[FIGURE x]\na\n## p. 1\n## p. 99999999999\n[FIGURE y]"]
