"""Cells made of texts without letters, against SQL."""

import duckdb

from folioflow import catalog


def test_planning_cells_of_texts_without_letters(spark, tmp_path):
    texts = ["un mot", None, "", " \n\t ", "123 = 456", ". ; .", "x", "== ==", "mot (a) 3) plan", "chapitre 4 : x", "É", "12."]
    rows = [(i, t, "fr", "s", len(t or "")) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    asked = con.execute(catalog.oracle_sql()["c28_planning_cells"])
    names = [c[0] for c in asked.description]
    want = sorted(asked.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in catalog.queries()["c28_planning_cells"](spark, str(tmp_path)).collect())
    assert got == want
