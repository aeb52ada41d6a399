"""Operators on small inline tables that carry shapes the generated tables lack."""

import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as tx
from folioflow.operators import chunking, cleaning, embedding, encoding, joblog, layout, parsing, planning, quality, repair, retrieval, review, tables
from folioflow.plans import jobs
from folioflow.schemas import CHUNKS, DOCUMENTS, Scope
from folioflow.sources import files
from folioflow.streaming import indexing


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- sources ---------------------------------------------------------------------------------


def test_files_are_typed_by_content(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes(b"  %PDF-1.7 body")
    (tmp_path / "y.md").write_bytes(b"# title")
    (tmp_path / "z.bin").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1"))
    got = {r["path"].split("/")[-1]: r for r in files.sniff_media_type(files.read_files(spark, str(tmp_path))).collect()}
    assert got["x.txt"]["media_type"] == files.TYPES["pdf"] and got["x.txt"]["warnings"] == ["MEDIA_TYPE_MISMATCH"]
    assert got["y.md"]["media_type"] == "text/markdown" and got["z.bin"]["warnings"] == ["LEGACY_DOC_FORMAT"]


def test_payload_gate(spark):
    b64 = lambda b: base64.b64encode(b).decode()
    data = [(1, b64(b"hello"), "text/plain"), (2, "***", "text/plain"), (3, "", "text/plain"), (4, b64(b"??"), files.GENERIC), (5, b64(bytes.fromhex("D0CF11E0A1B11AE1")), "text/plain"), (6, None, "text/plain")]
    ok, bad = files.gate_payloads(spark.createDataFrame(data, "id int, payload string, media_type string"))
    assert [r["id"] for r in ok.collect()] == [1]
    assert {r["id"]: r["code"] for r in bad.collect()} == {2: "INVALID_BASE64", 3: "EMPTY_DOCUMENT", 4: "UNSUPPORTED_MEDIA_TYPE", 5: "LEGACY_DOC_FORMAT", 6: "INVALID_BASE64"}
    broken = spark.createDataFrame([(bytearray(b"caf\xe9!"),)], "b binary").select(files.decode_text(F.col("b")).alias("t")).first()["t"]
    assert broken == "caf�!"


# --- text functions --------------------------------------------------------------------------


def test_fold_is_nfkd_for_latin_letters(spark):
    import unicodedata

    letters = "".join(map(chr, [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)])) + "Œ’é"
    want = "".join(c for c in unicodedata.normalize("NFKD", letters.replace("’", "'")) if not unicodedata.combining(c)).lower()
    assert one(spark, letters, tx.fold) == want


def test_excerpt_and_elisions(spark):
    assert one(spark, "  alpha beta gamma ", lambda c: tx.excerpt(c, 12)) == "alpha beta…"
    assert one(spark, "abcdefghij", lambda c: tx.excerpt(c, 4)) == "abcd…"
    assert one(spark, "le mois d' octobre et qu' il", tx.mend_elisions) == "le mois d'octobre et qu'il"
    assert one(spark, "Feuille 1 84  feuillet 9", tx.digit_key) == one(spark, "Feuille 184feuillet9", tx.digit_key)


# --- tables ----------------------------------------------------------------------------------


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep")], "external_id string, indexed_at int, content string")
    batch = spark.createDataFrame([("a", 2, "new"), ("a", 1, "stale"), ("c", 1, "add")], current.schema)
    first = tables.upsert_documents(current, batch)
    again = tables.upsert_documents(first, batch)
    assert rows(first, "external_id") == rows(again, "external_id") == [("a", 2, "new"), ("b", 1, "keep"), ("c", 1, "add")]


def test_notebook_needs_an_owner(spark):
    docs = spark.createDataFrame([("n", None, 1)], "external_id string, student_account_id string, indexed_at int")
    with pytest.raises(ValueError):
        tables.upsert_notebook(docs, docs, docs, docs)
    with pytest.raises(ValueError):
        tables.list_notebook(docs, " ")
    with pytest.raises(ValueError):
        retrieval.search_notebook(docs, docs.drop("student_account_id"))


def test_mixed_dimensions_and_no_passage(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "external_id string")
    chunks = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0]), ("b", [0.0, 0.0])], "external_id string, embedding array<float>")
    assert rows(tables.gate_embeddings(docs, chunks), "external_id") == [("a", 2, "MIXED_DIMENSIONS"), ("b", 2, None), ("c", None, "NO_PASSAGE")]


def test_scope_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([("1", "sn", "math", "l", "", "t", "v", "fr", "c", "r")], "external_id string, country string, subject string, level string, track string, grade string, curriculum_version string, language string, course_id string, role string").write.parquet(f"{tmp_path}/d")
    scope = Scope("sn", "math", "t", "v", "fr")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = spark.read.parquet(f"{tmp_path}/d").filter(retrieval.scope_filter(scope))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(country,sn)" in plan and "EqualTo(level" not in plan


# --- search ----------------------------------------------------------------------------------


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    vectors = (centres[rng.integers(0, 40, 2000)] + 0.15 * rng.normal(size=(2000, 32))).astype(float)
    passages = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 2000, 40)], "query_id int, vector array<double>")
    exact = {(r["query_id"], r["chunk_id"]) for r in retrieval.search(passages, queries, [], 10).collect()}
    near = {(r["query_id"], r["chunk_id"]) for r in retrieval.search_approx(passages, queries, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_zero_vectors_are_never_found(spark):
    passages = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "chunk_id int, embedding array<double>")
    assert [r["chunk_id"] for r in retrieval.search_one(passages, [1.0, 0.0], 5).collect()] == [2]


# --- chunking --------------------------------------------------------------------------------


def test_chunks(spark):
    rng = random.Random(1)
    parts = ["# Part A", "intro text here", "## Point 1"] + [" ".join("word%d" % rng.randrange(99) for _ in range(30)) for _ in range(40)] + ["### Deep", "Long " + "word " * 900 + "end. Second Sentence here.", "tail"]
    docs = spark.createDataFrame([("d", "\n\n".join(parts)), ("e", ""), ("f", None), ("g", "  \n ")], "external_id string, content string")
    got = chunking.chunk_corpus(docs, 100, 20, 10).orderBy("ordinal").collect()
    assert {r["external_id"] for r in got} == {"d"} and [r["ordinal"] for r in got] == list(range(len(got)))
    assert all(r["token_count"] <= 100 and r["token_count"] == chunking.heuristic(r["content"]) for r in got)
    assert got[0]["locator"] == "Part A · §1" and got[-1]["locator"].startswith("Part A > Point 1 > Deep · §")
    assert set(got[2]["content"].split()[:3]) <= set(got[1]["content"].split())
    with pytest.raises(ValueError):
        chunking.chunk_corpus(docs, 10, 10)


def test_heading_level_jump_is_not_padded(spark):
    docs = spark.createDataFrame([("d", "# A\n\nx\n\n### B\n\ny\n\n### C\n\nz")], "external_id string, content string")
    assert [tuple(r["heading_path"]) for r in chunking.split_blocks(docs).orderBy("position").collect()] == [("A",), ("A", "B"), ("A", "B", "C")]


def test_parts_follow_paragraphs(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(["a" * 40, "b" * 40, "c" * 40])), (2, "short")], "doc_id int, text string")
    got = rows(chunking.split_parts(docs, 90), "doc_id", "part_no")
    assert got == [(1, 0, "a" * 40 + "\n\n" + "b" * 40), (1, 1, "c" * 40), (2, 0, "short")]


# --- cleaning --------------------------------------------------------------------------------


def test_split_words_are_mended(spark):
    text = "Au print emps la rivière riv ière. Le marais de Lemarais est le marais plat. Au printemps la rivière.\nchimis-\nterie d' avril"
    got = cleaning.clean_corpus(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"))
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert "Au printemps la rivière rivière." in by[1] and "Le marais de Lemarais" in by[1] and "chimisterie d'avril" in by[1]
    assert by[2] == by[3] == ""


def test_furniture_goes_and_content_stays(spark):
    pages = [f"## p. {n}\n\nChapitre\n| 1 | row |\nBody line number {n} is unlike x{n}\nTome 3 - feuille {n} 0" for n in range(1, 10)]
    text = next(r["text"] for r in cleaning.clean_corpus(spark.createDataFrame([(1, "\n".join(pages))], "doc_id int, text string")).collect())
    assert "Tome" not in text and text.count("| 1 | row |") == 9 and "Chapitre" in text


# --- quality ---------------------------------------------------------------------------------


def test_quality_scores(spark):
    texts = ["Le cours de mathématiques commence aujourd'hui.", "Le cours de mathŽmatiques cžmmence", "x² + u₀", "", None, "mot (cid:12) mot"]
    got = {r["id"]: r["quality"] for r in quality.assess(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()}
    assert got[0]["score"] == 1.0 and got[1]["word_plausibility"] < 0.7 and got[2]["word_plausibility"] == 1.0
    assert got[3]["score"] == got[4]["score"] == 0.0 and got[5]["cid_markers"] == 1


def test_issues_have_offsets(spark):
    cell = "une cellule assez longue pour être comptée deux fois"
    texts = ["Le mÈtier du brÈlÈur est ancien et rude.", "Voici un bout Lu q k w z au milieu du reste.", "a) premier b) second (c", f"| {cell} | x |\n| y | {cell} |", "Suite.", "Le métier du brûleur", "b et b c d ≤ e f g h dans cette formule-là"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = {(r["id"], r["kind"], r["start"], r["end"]) for r in quality.issues(table, "id").collect()}
    assert {(0, "ENCODING", 4, 5), (0, "ENCODING", 15, 16), (0, "ENCODING", 17, 18)} <= found
    assert (1, "OCR_NOISE", 14, 24) in found and (3, "DUPLICATE_CELL", texts[3].rindex(cell), texts[3].rindex(cell) + len(cell)) in found
    assert (4, "THIN", 0, 6) in found and not any(i == 5 for i, *_ in found) and any(i == 6 and k == "FORMULA" for i, k, *_ in found)
    sure = {r["id"]: r["confidence"] for r in quality.section_confidence(table, quality.issues(table, "id"), "id").collect()}
    assert sure[5] == 1.0 and sure[0] == 0.7


# --- repair ----------------------------------------------------------------------------------


def test_notes_change_only_by_proof(spark):
    lines = ["same line", "close line", "far (line", "Même  texte.", "x"]
    seg = spark.createDataFrame([("n", i, t) for i, t in enumerate(lines)], "doc_id string, ordinal int, original string")
    proofs = spark.createDataFrame([("n", 0, "other", 0.01), ("n", 1, "proved line", 0.18), ("n", 2, "no proof", 0.62), ("n", 3, "meme texte", 0.1)], "doc_id string, ordinal int, proof_text string, distance double")
    got = repair.repair(seg, proofs.withColumn("source", F.lit("s")), ["doc_id", "ordinal"])
    assert [(r["status"], r["text"], r["reason"]) for r in got.orderBy("ordinal").collect()] == [
        ("inchange", "same line", ""), ("corrige", "proved line", ""), ("a-verifier", "far (line", "PARENTHESE_NON_FERMEE"), ("inchange", "Même  texte.", ""), ("inchange", "x", ""),
    ]
    notes = spark.createDataFrame([("n",), ("empty",)], "doc_id string")
    report = {r["doc_id"]: r for r in repair.repair_report(got, notes).collect()}
    assert report["empty"]["warnings"] == ["NOTEBOOK_EMPTY_TRANSCRIPTION"] and report["n"]["sources"] == ["s"] and report["n"]["corrected"] == 1


# --- encoding, planning, layout ----------------------------------------------------------------


def test_fonts_are_repaired_one_by_one(spark):
    good = "école théorème problème élève règle forêt fenêtre mémoire déjà après".split() * 3
    bad = [w.encode("mac_roman").decode("cp1252", "replace") for w in good]
    words = [(1, "Bad", w) for w in bad] + [(1, "Fine", w) for w in good] + [(1, "Symbol", "£")] * 30 + [(1, "Few", "Ž")]
    table = spark.createDataFrame(words, "doc_id int, font string, text string")
    chosen = encoding.choose_font_tables(table)
    labels = {r["font"]: r["label"] for r in chosen.collect()}
    assert labels == {"Bad": "mac_roman read as cp1252", "Fine": "none", "Symbol": "symbol", "Few": "ignored"}
    plan = {r["word"]: r["fixed"] for r in encoding.word_plan(table, chosen).collect()}
    assert plan[bad[0]] == "école" and "école" not in plan


def test_dominant_script(spark):
    texts = [(1, "Bonjour à tous"), (2, "Привет всем"), (3, "abc где abc где"), (4, "123"), (5, None)]
    assert dict(rows(encoding.dominant_script(spark.createDataFrame(texts, "doc_id int, text string")), "doc_id")) == {1: "latin", 2: "cyrillic", 3: "mixed", 4: "unknown", 5: "unknown"}
    pieces = [(1, "abc", True), (1, "где это", False), (2, "abcabc", False), (2, "где", False), (3, "abcdefgh", False), (3, "и", False), (4, None, True)]
    by_font = encoding.dominant_script(spark.createDataFrame(pieces, "doc_id int, text string, sure boolean"), trusted_col="sure")
    assert dict(rows(by_font, "doc_id")) == {1: "latin", 2: "cyrillic", 3: "unknown", 4: "unknown"}


def test_notebook_jobs_leave_the_shared_tables_alone(spark, tmp_path):
    """Repair of notes and indexing of a notebook read the teachers' tables and write none of them."""
    shared = spark.createDataFrame([("c1", 0, "validated line", [1.0, 0.0], "fr", "published_course")], "chunk_id string, ordinal int, content string, embedding array<double>, language string, role string")
    shared.write.parquet(f"{tmp_path}/chunks")
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "chunks").iterdir())
    base = spark.read.parquet(f"{tmp_path}/chunks")
    lines = repair.split_segments(spark.createDataFrame([("n", "validated line\nother")], "doc_id string, text string"))
    asked = lines.select(F.concat_ws("#", "doc_id", "ordinal").alias("segment_id"), F.array(F.lit(1.0), F.lit(0.1)).alias("vector"), F.lit("fr").alias("language"))
    assert {r["chunk_id"] for r in retrieval.find_proofs(asked, base, ["language"]).collect()} == {"c1"}
    own = spark.createDataFrame([("n", "u1", 1)], "external_id string, student_account_id string, indexed_at int")
    chunks = spark.createDataFrame([("n", "u1", 0, "x")], "external_id string, student_account_id string, ordinal int, content string")
    documents, passages = tables.upsert_notebook(own.limit(0), chunks.limit(0), own, chunks)
    documents.write.parquet(f"{tmp_path}/own/documents")
    passages.write.parquet(f"{tmp_path}/own/chunks")
    assert sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "chunks").iterdir()) == before
    assert rows(spark.read.parquet(f"{tmp_path}/chunks"), "chunk_id") == rows(shared, "chunk_id")


def test_plannings(spark):
    text = "\n".join([
        "Discipline : Mathématiques  Niveau : Terminale S (6 heures / semaine)", "Année 2024 - 2025",
        "| Périodes | Leçons | Objectifs | Évaluation |", "| Mois d'octobre | | | |",
        "| Semaine 1 Semaine 2 | Chapitre 1 : Suites (limites, calcul) | 1. Définir une suite. 2. Calculer | Devoir 1 |",
        "| | | 2. Calculer | |", "| NOVEMBRE |", "| Semaine 1 | Chapitre 1 (suite et fin) | 1. Conclure | |", "| Semaine 2 | Fonctions 1) Rappels 2) Limites | | |",
    ])
    out = planning.parse_plannings(spark.createDataFrame([(1, text), (2, "rien")], "doc_id int, text string"))
    first, second = out["entries"].orderBy("position").collect()
    assert (first["chapter"], first["details"], first["objectives"], first["assessments"]) == ("Suites", "limites, calcul", ["Définir une suite", "Calculer", "Conclure"], ["Devoir 1"])
    assert [(p["month"], p["weeks"]) for p in first["periods"]] == [("octobre", [1, 2]), ("novembre", [1])]
    assert second["chapter"] == "Fonctions" and second["details"].startswith("1) Rappels")
    told = {r["doc_id"]: r for r in out["plannings"].collect()}
    assert told[1]["warnings"] == [] and (told[1]["school_year"], told[1]["weekly_hours"], told[1]["subject"], told[1]["grade_label"]) == ("2024-2025", 6, "Mathématiques", "Terminale S")
    assert "PLANNING_NOT_RECOGNISED" in told[2]["warnings"]


def positioned(spark):
    words = []
    for line in range(8):
        for column, x in enumerate((20, 220)):
            words += [(1, 1, len(words) + k, f"c{column}l{line}w{k}", x + 40.0 * k, x + 40.0 * k + 35, 12.0 * line, 12.0 * line + 10, "f", None) for k in range(3)]
    return spark.createDataFrame(words, "doc_id int, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, font string, mcid int")


def test_columns(spark):
    words = positioned(spark)
    metrics = layout.layout_metrics(words)
    assert tuple(metrics.first()) == (1, 10.0, 5.0, 12.0)
    lined = layout.visual_lines(words, metrics)
    assert layout.line_texts(lined).count() == 8
    sizes = spark.createDataFrame([(1, 1, 500.0)], "doc_id int, page_no int, width double")
    (gutter,) = [g for g in layout.gutters(lined, metrics, sizes).collect() if g["x0"] > 100 and g["x1"] < 300]
    assert 130 <= gutter["x0"] <= 137 and 218 <= gutter["x1"] <= 221
    columns = spark.createDataFrame([(1, 1, 0, 0.0, 200.0), (1, 1, 1, 200.0, 500.0)], "doc_id int, page_no int, column int, left double, right double")
    placed = layout.assign_columns(words, columns)
    assert all(r["text"].startswith(f"c{r['column']}") for r in placed.collect())
    text = layout.render_columns(words, columns, metrics).first()["text"]
    assert text.split("\n")[0].startswith("| c0l0w0")
    assert layout.clustered_boundaries(lined, sizes).count() == 2
    assert layout.column_template(layout.gutters(lined, metrics, sizes), words).count() == 0


def test_regions(spark):
    star = [("curve", 100.0 + i, 100.0, 150.0 + i, 160.0) for i in range(3)]
    frame = [("line", 300.0, 300.0, 400.0, 300.0), ("line", 300.0, 300.0, 300.0, 380.0)]
    rule = [("line", 20.0, 500.0, 200.0, 500.0), ("line", 20.0, 510.0, 200.0, 510.0)]
    shapes = spark.createDataFrame([(1, p, k, *b, 600.0, 800.0) for p in (1, 2, 3) for k, *b in (star + frame + rule if p == 1 else star)], "doc_id int, page_no int, kind string, x0 double, top double, x1 double, bottom double, width double, height double")
    found = layout.figure_regions(shapes, positioned(spark))
    assert {(r["page_no"], r["x0"]) for r in found.collect()} == {(1, 100.0), (1, 300.0), (2, 100.0), (3, 100.0)}
    assert {(r["page_no"], r["x0"]) for r in layout.drop_region_furniture(found).collect()} == {(1, 300.0)}


def test_routes_and_marks(spark):
    profile = spark.createDataFrame([(1, 3, 3, "latin", None, 0, None, 0), (2, 3, 0, "arabic", None, 0, None, 0), (3, 3, 0, "latin", 0.95, 4, True, 0), (4, 3, 1, "mixed", 0.5, 4, True, 2)], "doc_id int, pages int, ocr_pages int, script string, coverage double, depth int, semantic boolean, ruled_pages int")
    assert [r["route"] for r in layout.route_documents(profile).orderBy("doc_id").collect()] == ["needs-ocr", "non-latin", "tagged", "untagged"]
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0, 10.0, 9000.0, 0), (1, 2, 100.0, 100.0, 1500.0, 0.0, 2)], "doc_id int, page_no int, width double, height double, text_area double, image_area double, long_rules int")
    flags = layout.flag_ocr(pages, spark.createDataFrame([(1, "short")], "doc_id int, text string")).first()
    assert flags["pages_needing_ocr"] == [1] and flags["too_thin"]
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "doc_id int, page_no int, mcid int")
    assert layout.tag_coverage(marks, marks.limit(1)).first()["coverage"] == 0.5
    cells = spark.createDataFrame([(1, 1, 1, 1, 5, "a"), (1, 1, 1, 2, 6, "a"), (1, 1, 2, 1, 7, "a"), (1, 1, 3, 1, 5, "b")], "doc_id int, table_no int, row_no int, cell_no int, mark int, text string")
    assert [r["text"] for r in layout.dedupe_cells(cells).orderBy("row_no", "cell_no").collect()] == ["a", "", "a", ""]
    pieces = spark.createDataFrame([(["l’", "affixe", "(", "u", ",", "v", ")"],)], "p array<string>")
    assert pieces.select(layout.join_fragments(F.col("p"))).first()[0] == "l’affixe (u, v)"


# --- parsing and review ------------------------------------------------------------------------


def test_tagged_answers(spark):
    quiz = "Bla\n### QUESTION\nCombien ?\nA) un\nB) deux\nC) trois\nD) quatre\n### RÉPONSE: B\n### EXPLICATION\nLa réponse correcte est C.\n### QUESTION\nCourt\nA) x\n### RÉPONSE A"
    work = "### EXERCICE (difficile)\n<énoncé>\nCalculer\n### CORRIGÉ\nOui\n### EXERCICE\nSans corrigé"
    table = spark.createDataFrame([(1, quiz), (2, work), (3, None)], "request_id int, raw string")
    (q,) = parsing.parse_quizzes(table).collect()
    assert (q["question"], q["choices"], q["answer"], q["explanation"]) == ("Combien ?", ["un", "deux", "trois", "quatre"], 1, "La réponse correcte est C.")
    assert review.contradicted_quizzes(parsing.parse_quizzes(table)).first()["suggested"] == 2
    (x,) = parsing.parse_exercises(table).collect()
    assert (x["statement"], x["solution"], x["difficulty"]) == ("Calculer", "Oui", "difficile")
    assert {r["request_id"]: r["dropped"] for r in parsing.block_report(table, parsing.parse_quizzes(table), parsing.QUESTION).collect()}[1] == 1
    findings = "### PROBLÈME\nGravité : haute\nExtrait : le texte cité\nExplication : faux signe\nCorrection : le bon texte\n### AUCUN\nrien"
    (f,) = parsing.parse_findings(spark.createDataFrame([(1, findings)], "request_id int, raw string")).collect()
    assert (f["severity"], f["quote"], f["explanation"], f["correction"]) == ("haute", "le texte cité", "faux signe", "le bon texte")


def test_json_and_plans(spark):
    raw = 'text {"heading": "T", "sections": [{"heading": "A", "children": [{"heading": "a1"}, {"heading": " "}]}, {"heading": ""}]} more {"x": "\\q {"} {bad'
    table = spark.createDataFrame([(1, raw), (2, None)], "request_id int, raw string")
    assert parsing.json_objects(table).count() == 2
    assert rows(parsing.parse_plans(table), F.col("child_no").asc_nulls_first()) == [(1, 0, None, "A"), (1, 0, 0, "a1")]
    assert one(spark, '{"answer": "First. Second \\"x\\" is cut', lambda c: parsing.rescue_text(c, "answer")) == "First."
    assert one(spark, 'before {"a": {"b": 1}} after', parsing.strip_leaked_objects) == "before  after"


def test_repetition_formulas_and_speech(spark):
    assert one(spark, "Start. " + "abc " * 80, parsing.cut_repetition) == "Start. "
    assert one(spark, "An ordinary text. " * 3, parsing.cut_repetition) == "An ordinary text. " * 3
    assert one(spark, "\x08eta \x0crac \\\\alpha", parsing.mend_formulas) == "\\beta \\frac \\alpha"
    assert one(spark, "## p. 3\nTitre\n\nx² ≤ 4\nsuite\n\n| a | b |", parsing.spoken) == "Titre. x au carré est inférieur ou égal à 4 suite. Voir le tableau."
    pairs = parsing.formula_pairs(spark.createDataFrame([(1, "on a \\(a = b = c\\) et $x \\le 2$")], "id int, text string"), "id")
    assert [(r["left"], r["right"]) for r in pairs.orderBy("pair_no").collect()] == [("a", "b"), ("b", "c")]


def test_quotes_points_and_conversations(spark):
    texts = spark.createDataFrame([("d", "un deux\n\ntrois quatre un")], "doc_id string, text string")
    quotes = spark.createDataFrame([("d", 1, "deux trois"), ("d", 2, "un"), ("d", 3, "cinq"), ("d", 4, " ")], "doc_id string, quote_id int, quote string")
    assert {r["quote_id"]: (r["position"], r["code"]) for r in review.locate_quotes(texts, quotes).collect()} == {1: (3, None), 2: (None, "AMBIGUOUS"), 3: (None, "NOT_FOUND"), 4: (None, "EMPTY")}
    items = spark.createDataFrame([("a", 1, 5, 20), ("a", 2, 5, 20), ("a", 3, 13, 20), ("b", 1, 0, 4)], "assessment_id string, item_no int, points int, total int")
    assert [r["points"] for r in review.rebalance_points(items).orderBy("assessment_id", "item_no").collect()] == [5, 4, 11, 4]
    turns = spark.createDataFrame([(1, 1, "assistant", "La réponse est douze car six fois deux."), (1, 2, "user", "?"), (1, 3, "assistant", "La réponse est douze car six fois deux !"), (2, 1, "assistant", "autre")], "conv_id int, turn int, role string, text string")
    assert rows(review.repeated_answers(turns), "conv_id") == [(1, 3, 1)]
    pars = spark.createDataFrame([(1, 1, "cite [S1]"), (1, 2, "encore [S1] [FIGURE f2]")], "section_id int, par_no int, text string")
    registry = spark.createDataFrame([(1, "S1", ["f1", "f2"])], "section_id int, label string, figures array<string>")
    assert rows(review.place_figures(pars, registry), "figure") == [(1, "f1", 1)]
    damage = review.text_damage(spark.createDataFrame([("d’̈finie \\[ x \\omega",), ("\\alpha seul $x$",)], "text string")).collect()
    assert (damage[0]["formula_orphans"], damage[0]["stray_accents"], damage[1]["naked_commands"]) == (1, 1, 1)


# --- jobs --------------------------------------------------------------------------------------


def test_queue(spark):
    log = [(1, "teacher", 0.0, 0.0, 100.0, "done"), (2, "teacher", 10.0, 130.0, 200.0, "done"), (3, "student", 20.0, 100.0, 130.0, "done"), (4, "teacher", 30.0, 200.0, 300.0, "failed")]
    table = spark.createDataFrame(log, "job_id int, lane string, submitted_at double, started_at double, finished_at double, status string")
    assert rows(joblog.queue_positions(table), "job_id") == [(1, 0), (2, 0), (3, 0), (4, 2)]
    wait = {r["job_id"]: r["wait_seconds"] for r in joblog.announced_wait(table).collect()}
    assert wait == {1: 150.0, 2: 140.0 + 150.0, 3: 130.0 + 35.0, 4: 2 * 150.0 + 120.0 + 150.0}


def test_embedding_retries_and_checks(spark):
    table = spark.createDataFrame([("a b",), (None,), ("b a",)], "content string").coalesce(1)
    got = [r["embedding"] for r in embedding.embed(table, "content", embedding.hashing_encoder(8), batch=2).collect()]
    assert got[0] == got[2] and len(got[1]) == 8
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        embedding.embed(table, "content", lambda texts: np.zeros((1, 4)), batch=2, attempts=1).collect()


def requests(spark, *some):
    base = {f.name: None for f in DOCUMENTS.fields} | {"country": "sn", "level": "", "track": ""}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in DOCUMENTS.fields) for r in some], DOCUMENTS)


def test_index_corpus(spark):
    import datetime as dt

    when = dt.datetime(2024, 1, 1)
    batch = requests(
        spark,
        {"external_id": "a", "role": "teacher_material", "course_id": "c", "content": "some words " * 300, "indexed_at": when},
        {"external_id": "b", "role": "teacher_material", "course_id": "", "content": "text", "indexed_at": when},
        {"external_id": "c", "role": "past_paper", "course_id": "", "content": "  ", "indexed_at": when},
    )
    nothing = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS)
    out = jobs.index_corpus(*nothing, batch, embedding.hashing_encoder(16), "hash")
    assert rows(out["rejected"], "external_id") == [("b", "COURSE_REQUIRED"), ("c", "NO_PASSAGE")]
    again = jobs.index_corpus(out["documents"], out["chunks"], batch, embedding.hashing_encoder(16), "hash")
    assert rows(again["chunks"], "chunk_id") == rows(out["chunks"], "chunk_id") and again["documents"].count() == 1
    assert tables.check_keys(out["documents"], out["chunks"]).count() == 0 and out["documents"].first()["chunk_count"] == out["chunks"].count()


def test_inspect_and_audit(spark):
    found = jobs.inspect_corpus(spark.createDataFrame([(1, "# T\n\nUn texte propre et assez long pour passer.\n\nsÈns Žtrange")], "doc_id int, text string"))
    assert found["sections"].count() == 2 and rows(found["summary"], "kind")[0][:2] == (1, "ENCODING")
    sections = spark.createDataFrame([("c", 1, "Le signe est négatif ici. \\[ x"), ("c", 2, "Autre contenu")], "course_id string, section_id int, content string")
    findings = spark.createDataFrame([(1, "c", "high", "signe est négatif"), (2, "c", "low", "jamais écrit ici")], "finding_id int, course_id string, severity string, quote string")
    quizzes = spark.createDataFrame([("c", "la réponse est A.", 1)], "course_id string, explanation string, answer int")
    out = jobs.audit_courses(quizzes, sections, findings)
    assert [(r["finding_id"], r["section_id"]) for r in out["findings"].collect()] == [(1, 1)] and out["not_found"].first()["finding_id"] == 2
    assert out["quizzes"].count() == 1 and out["formulas"].first()["section_id"] == 1
    log = spark.createDataFrame([({"Password": "x", "note": "Authorization: Bearer abc.def"},)], "a map<string,string>")
    assert jobs.redact_logs(log, "a", ["password"]).first()["a"] == {"Password": "[REDACTED]", "note": "Authorization: Bearer [REDACTED]"}


def test_registered_queries_read_whole_texts(spark, tmp_path, monkeypatch):
    """What stands beyond the first 200 characters is looked at."""
    from folioflow import catalog

    far, cell = "mot " * 80, "une cellule assez longue pour compter deux fois"
    texts = [f"{far} La bonne réponse est D) .", f"{far}\n{cell}\nfin 1 2\n{cell}", f"{far} fin de ligne"]
    spark.createDataFrame([(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    assert (0, 3) in run("c23_contradicted_quizzes")
    assert run("n2_duplicate_cells") == [(1, 1)]
    assert (1, 2, "fin#") in run("c2_digit_key")
    assert sorted(run("c4_same_text")) == [(i, True) for i in range(3)]
    assert sorted(run("u3_multiset_diff")) == [("added", 0, "ajout"), ("removed", 2, "mot"), ("removed", 2, "mot")]
    assert sorted(len(r[2]) for r in run("j18_apply_revisions")) == sorted([len(texts[1]) + 1, len(texts[2]), len(texts[2])])
    seen, classify = [], review.classify_proposals
    monkeypatch.setattr(review, "classify_proposals", lambda edits: seen.append(edits) or classify(edits))
    assert dict(run("c34_classify_proposals")) == {0: "UNCERTAIN", 1: "UNCHANGED", 2: "REWRITTEN"}
    assert {r["before"] for r in seen[0].collect()} == {"x" + "".join(t.split()) for t in texts}


def test_multiset_diff_counts_repeats(spark):
    a, b = ({None: 2, "x": 3, "z": 1}, {None: 1, "x": 20005, "y": 1, "z": 1})
    table = lambda counts: spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "w string")
    added, removed = review.multiset_diff(table(a), table(b))
    assert {r["w"]: r["count"] for r in added.groupBy("w").count().collect()} == {"x": 20002, "y": 1}
    assert [r["w"] for r in removed.collect()] == [None]


def test_hot_sources_are_not_held_in_one_task(spark, tmp_path, monkeypatch):
    """One source of 450 documents: values of 200 documents at most, no window over the source, no broadcast by hint."""
    from folioflow import catalog

    spark.createDataFrame([(i, f"texte {i}", "fr", "s", 9) for i in range(450)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assembled, assemble = [], cleaning.assemble_pages
    monkeypatch.setattr(cleaning, "assemble_pages", lambda pages: assembled.append(assemble(pages)) or assembled[-1])
    r7 = catalog.queries()["r7_split_pages"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["page_no"], r["text"]) for r in r7) == [("s", i, f"texte {i}") for i in range(450)]
    c26 = catalog.queries()["c26_figure_marks"](spark, str(tmp_path)).collect()
    assert sum(str(tuple(r)).count("[FIGURE f") for r in c26) == 150
    for pages in assembled:
        assert max(r["text"].count("## p. ") for r in pages.collect()) == 200
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    items = spark.createDataFrame([(r, p, i) for r in ("a", None) for p in (0, 1, None) for i in range(30)], "request_id string, part_no int, item_no int")
    capped = review.cap_items(items, 5)
    assert "collect_set" not in plan(capped) and Counter(r["request_id"] for r in capped.collect()) == {"a": 5, None: 5}
    sources = spark.createDataFrame([(r, i, "x" * 50) for r in ("a", None) for i in range(4)], "request_id string, doc_id int, text string")
    fitted = review.fit_sources(sources, 100, 10)
    assert "Window" not in plan(fitted) and [(len(r["text"]), r["truncated"]) for r in fitted.collect()] == [(25, True)] * 8
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "chunk_id int, embedding array<double>")
    near = retrieval.search(vectors, vectors.selectExpr("chunk_id query_id", "embedding vector"), [], 1)
    assert "broadcast" not in plan(near) and {(r["query_id"], r["chunk_id"]) for r in near.collect()} == {(i, i) for i in range(5)}
