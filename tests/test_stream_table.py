"""Replacement of rows: the streamed table against a plain dictionary, and bitmaps of keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import bitmaps
from folioflow.operators import tables
from folioflow.streaming.indexing import StreamTable, index_stream

SCHEMA = "external_id string, indexed_at int, content string, _deleted boolean"


def held(df):
    return sorted(tuple(r) for r in df.collect())


class Model:
    """What the table has to hold: of each key the latest version, deletions before others of one time."""

    def __init__(self):
        self.best = {}

    def put(self, rows):
        for key, at, text, gone in rows:
            new = (at, bool(gone), [-ord(c) for c in text or ""])
            if key not in self.best or new > self.best[key][0]:
                self.best[key] = (new, (key, at, text))

    def rows(self):
        return sorted(row for (_, gone, _), row in self.best.values() if not gone)


def written(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_stream_replaces_deletes_and_replays(spark, tmp_path):
    table = StreamTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, depth=1, most=2)

    def feed(*some):
        spark.createDataFrame(list(some), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        index_stream(stream, table, f"{tmp_path}/ckpt").awaitTermination()
        return held(table.current())

    assert feed(("a", 1, "one", None), ("a", 2, "two", False), ("b", 1, "b", False)) == [("a", 2, "two"), ("b", 1, "b")]
    more = [("b", 3, "new", False), ("c", 1, "c", False), ("a", 1, "late", False)]
    want = [("a", 2, "two"), ("b", 3, "new"), ("c", 1, "c")]
    assert feed(*more) == want
    last = table.manifests()[-1]
    for _ in range(2):
        table.apply(last, spark.createDataFrame(more, SCHEMA))
        assert held(table.current()) == want
    assert held(table.before(last)) == [("a", 2, "two"), ("b", 1, "b")]
    assert feed(("a", 2, None, True), ("c", 0, None, True), ("zz", 5, None, True)) == [("b", 3, "new"), ("c", 1, "c")]
    assert feed(("a", 2, "late again", False), ("zz", 4, "late", False)) == [("b", 3, "new"), ("c", 1, "c")]
    assert feed(("a", 3, "back", False)) == [("a", 3, "back"), ("b", 3, "new"), ("c", 1, "c")]


def test_many_batches_equal_a_dictionary(spark, tmp_path):
    """Deltas are merged, buckets split, replays of the last batch change nothing."""
    rng = random.Random(1)
    table = StreamTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, depth=0, most=2, capacity=25)
    model = Model()
    for batch in range(14):
        rows = [(f"k{rng.randint(0, 90)}", rng.randint(0, 30), rng.choice(["x", "y", "z"]), rng.random() < 0.2) for _ in range(rng.choice([3, 30]))]
        if batch == 5:
            rows = rows[:1]
        df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        table.apply(batch, df)
        model.put(rows)
        if batch % 5 == 4:
            table.apply(batch, df)
        if batch % 3 == 1:
            assert held(table.current()) == model.rows()
    assert held(table.current()) == model.rows()
    state = table.state()
    assert len(state) > 4 and max(len(b.deltas) for b in state) <= 2
    assert sum(2.0 ** -len(b.bits) for b in state) == 1.0  # the buckets cover all hashes once
    assert len(table.manifests()) == 2


def test_what_is_written_follows_the_batch(spark, tmp_path):
    schema = "external_id string, indexed_at int, content string"
    table = StreamTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], schema).schema, depth=2, most=50)
    table.apply(0, spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("external_id"), F.lit(1).alias("indexed_at"), F.sha2(F.col("id").cast("string"), 256).alias("content")))
    before = written(tmp_path)
    for n in range(1, 4):
        table.apply(n, spark.createDataFrame([(f"k{i}", n + 1, "new") for i in range(10)], schema))
    assert written(tmp_path) - before < 0.05 * before
    assert table.current().filter("content = 'new'").count() == 10 and table.current().count() == 20_000


def test_rows_that_stay_are_not_shuffled(spark):
    current = spark.range(50_000).selectExpr("cast(id as string) external_id", "cast(id as int) indexed_at")
    incoming = spark.range(0, 60_000, 10).selectExpr("cast(id as string) external_id", "-1 indexed_at")
    out = tables.upsert_documents(current, incoming)
    assert out.count() == 51_000 and out.filter("indexed_at = -1").count() == 6000
    marked = bitmaps.with_mark(current, "external_id", bitmaps.bitmap_of(incoming.select("external_id"), "external_id"), "may")
    may = marked.filter("may").count()
    assert 5000 <= may <= 5000 + 0.1 * 45_000
    assert marked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1  # the bitmap's own sum


@pytest.mark.parametrize("most", [bitmaps.ROW_BITS, bitmaps.MOST])
def test_bitmaps_never_miss_a_key(spark, most):
    keys = spark.range(0, 40_000, 2).selectExpr("cast(id as string) k").unionByName(spark.createDataFrame([(None,)], "k string"))
    df = spark.range(40_000).selectExpr("cast(id as string) k").unionByName(spark.createDataFrame([(None,), ("x",)], "k string"))
    marked = bitmaps.with_mark(df, "k", bitmaps.bitmap_of(keys.filter("k is not null"), "k", most), "may")
    assert marked.filter("not may and try_cast(k as int) % 2 = 0").count() == 0 and marked.filter("k is null and not may").count() == 1
    left = bitmaps.without_keys(df, keys, "k")
    assert left.count() == 20_002 and left.filter("try_cast(k as int) % 2 = 0").count() == 0
    assert bitmaps.without_keys(df, keys.limit(0), "k").count() == df.count()
