"""Steps that compute once what several branches read, and that hold few texts at once."""

import datetime as dt
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions import slices
from folioflow.functions import text as tx
from folioflow.operators import chunking, embedding, parsing, planning
from folioflow.plans import jobs
from folioflow.schemas import CHUNKS, DOCUMENTS


def test_each_passage_is_embedded_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def encoder(texts):
        with open(seen, "a") as f:
            f.write("".join(f"{t[:5]}\n" for t in texts))
        return np.ones((len(texts), 2), np.float32)

    base = {f.name: None for f in DOCUMENTS.fields} | {"country": "sn", "level": "", "track": "", "role": "past_paper", "course_id": "", "indexed_at": dt.datetime(2024, 1, 1)}
    batch = spark.createDataFrame([tuple((base | {"external_id": f"d{i}", "content": f"text{i}"})[f.name] for f in DOCUMENTS.fields) for i in range(4)], DOCUMENTS)
    out = jobs.index_corpus(*(spark.createDataFrame([], s) for s in (DOCUMENTS, CHUNKS)), batch, encoder, "m")
    assert out["documents"].count() == out["chunks"].count() == 4 and out["rejected"].count() == 0
    with open(seen) as f:
        assert sorted(f.read().split()) == [f"text{i}" for i in range(4)]


def test_hashed_words_of_many_texts_equal_those_of_one():
    texts = ["Ab ab é", "", " x  y\nx ", "ab"]
    encode = embedding.hashing_encoder(8)
    assert np.array_equal(encode(texts), np.concatenate([encode([t]) for t in texts])) and encode([]).shape == (0, 8)


def test_counted_words_cut_as_counted_texts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "bc. ", "D", "\n", "\n\n", "# H\n", "! Z", "  ", " ", "\x1c", ". A"]) for _ in range(rng.randrange(120)))
        for sizes in ((384, 64, 32), (10, 3, 2), (1, 0, 1), (7, 6, 6)):
            assert chunking.chunks(text, *sizes, chunking.heuristic) == chunking.chunks(text, *sizes, lambda t: chunking.heuristic(t))


@pytest.mark.parametrize("step", ["chunk_corpus", "split_blocks", "json_objects", "json_fields"])
def test_few_texts_are_held_at_once(spark, monkeypatch, step):
    """Slices of a text each give the rows of one large slice, in order, and nulls and other kinds of ids stay."""
    texts = ['# A\n\nun {"a": 1} deux\n\n## B\n\ntrois', None, "", '{"b": "x"} {"c": 2}', "mot " * 700]
    docs = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)], "request_id string, text string").coalesce(1)
    run = {
        "chunk_corpus": lambda: chunking.chunk_corpus(docs, id_col="request_id", text_col="text"),
        "split_blocks": lambda: chunking.split_blocks(docs, "request_id", "text"),
        "json_objects": lambda: parsing.json_objects(docs, "text"),
        "json_fields": lambda: parsing.json_fields(docs, "text"),
    }[step]
    df = run()
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    whole = [tuple(r) for r in df.collect()]
    one_each = lambda batch, column, size=1: slices.text_slices(batch, column, 1)
    for module in (chunking, parsing):
        monkeypatch.setattr(module, "text_slices", one_each)
    assert [tuple(r) for r in run().collect()] == whole != []


def test_slices_hold_a_bounded_size():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 30, "c", "d"]})
    assert [p.num_rows for p in slices.text_slices(batch, "text", 12)] == [2, 1, 2]


def test_folded_words_are_found_as_in_the_folded_text(spark):
    texts = ["| Périodes |", "PÉ́RIODE", "pe riode", "| ﬁn periode", "½ p", "période".encode().decode(), "ṗẹṛịọḍẹ", "", None, "periode"[::-1], "ĲPERIODE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.contains(tx.fold(F.col("t")), F.lit("periode"))
    got = df.select(tx.fold_contains(F.col("t"), planning.ROLES["weeks"]), plain).collect()
    assert all(a == b for a, b in got) and sum(a is True for a, _ in got) == 6
    with pytest.raises(ValueError):
        tx.fold_contains(F.col("t"), ("week",))


def test_header_roles_are_read_in_rows_that_name_the_weeks_only(spark):
    df = planning.schedule_rows(spark.createDataFrame([(1, "| Périodes | Leçons |\n| Semaine 1 | a |")], "doc_id int, text string"))
    assert [(r["chapter_cell"], r["ruled"]) for r in df.collect()] == [("a", True)]
    assert "may_head" in df._jdf.queryExecution().analyzed().toString()


def test_formula_pattern_equals_the_one_with_a_look_at_each_character():
    old = r"(?s)(?:\\begin\{|\\[(\[]|\$)(?:(?!\\end\{|\\[)\]]|\$).)*+(?:\\end\{|\\[)\]]|\$)?"
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice(["\\", "$", "begin{", "end{", "(", ")", "[", "]", "a", "\n", "\t"]) for _ in range(rng.randrange(14)))
        assert [m.span() for m in re.finditer(old, text)] == [m.span() for m in re.finditer(parsing.FORMULA, text)]


def test_mending_looks_at_a_bound_text(spark):
    """The text stands once in the plan however many steps look at it."""
    df = spark.createDataFrame([("\x08eta $a\tau \\\\alpha$ \tb",), (None,)], "t string")
    made = df.select(parsing.mend_formulas(F.upper(F.col("t"))).alias("m"))
    assert made._jdf.queryExecution().analyzed().toString().count("upper(") == 1
    assert [r[0] for r in df.select(parsing.mend_formulas(F.col("t"))).collect()] == ["\\beta $a\\tau \\alpha$ \tb", None]
