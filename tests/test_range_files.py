"""A table cut by ranges of its key against a plain dictionary."""

import os
import random

from pyspark.sql import functions as F

from folioflow.operators.rangefiles import RangeTable

SCHEMA = "external_id string, indexed_at int, content string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, tmp_path, per_file=50):
    return RangeTable(spark, f"file://{tmp_path}/with space/table", frame(spark, []).schema, rows_per_file=per_file)


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_equal_a_dictionary(spark, tmp_path):
    some, rng, model = table(spark, tmp_path), random.Random(5), {}
    for step in range(3):
        low = rng.choice(["a", "k", "é", "𝄞", "￿"])
        rows = [(f"{rng.choice([low, 'm'])}{rng.randrange(120)}", step * 1000 + i, None if i % 9 == 0 else f"text {step} {i}") for i in range(150)]
        some.upsert(frame(spark, rows + [(None, 1, "no key")]))
        for k, at, text in rows:
            model[k] = (k, at, text)
        dead = rng.sample(sorted(model), 15)
        some.delete(spark.createDataFrame([(k,) for k in [*dead, "absent", None]], "external_id string"))
        for k in dead:
            del model[k]
        assert sorted(map(str, held(some.current()))) == sorted(map(str, model.values()))
    starts = [f.start for f in some.files()]
    assert len(set(starts)) == len(starts) > 3
    for f, after in zip(some.files(), [*starts[1:], None], strict=True):  # each file keeps within its range
        low, high, n = some._read([f]).agg(F.min("external_id"), F.max("external_id"), F.count("*")).first()
        assert low == f.start and n == f.rows and (after is None or high < after)


def test_other_files_stay_where_they_are(spark, tmp_path):
    some = table(spark, tmp_path)
    assert some.replace(frame(spark, [])) == {"rewritten": 0, "kept": 0} and some.current().count() == 0
    rows = [(f"{i:04d}", i, "old") for i in range(1000)]
    some.replace(frame(spark, rows))
    before = {f.file for f in some.files()}
    assert len(before) > 10
    where = {f: os.path.getmtime(f"{tmp_path}/with space/table/data/{f}") for f in before}
    new = frame(spark, [("0300", 9, "new"), ("0301", 9, "new")])
    for _ in range(2):  # a replay changes nothing
        done = some.upsert(new)
        assert done["rewritten"] == 1 and done["kept"] == len(before) - 1
        assert held(some.current()) == sorted((k, 9, "new") if k in ("0300", "0301") else (k, i, t) for k, i, t in rows)
    same = before & {f.file for f in some.files()}
    assert len(same) == len(before) - 1 and all(os.path.getmtime(f"{tmp_path}/with space/table/data/{f}") == where[f] for f in same)
    plan = some._read(some.files()[:1]).inputFiles()
    assert len(plan) == 1
    assert held(some.lookup(["0301", "zz"])) == [("0301", 9, "new")]
    assert some.vacuum() == 2 and some.vacuum() == 0 and some.current().count() == 1000
    some.delete(some.current().select("external_id"))
    assert some.current().count() == 0 and some.files() == []
    some.replace(frame(spark, rows[:3]))
    assert held(some.current()) == rows[:3]


def test_passages_of_a_document_stay_together(spark, tmp_path):
    some = table(spark, tmp_path, 20)
    rows = [("big", i, "x") for i in range(90)] + [(f"d{i:02d}", j, "y") for i in range(30) for j in range(3)]
    some.replace(frame(spark, rows).withColumn("extra", F.lit(1)))
    assert held(some.current()) == sorted(rows)
    some.replace(frame(spark, [("big", 0, "z")]), spark.createDataFrame([("big",), ("d03",)], "external_id string"))
    assert held(some.current()) == sorted([("big", 0, "z"), *(r for r in rows if r[0] not in ("big", "d03"))])
