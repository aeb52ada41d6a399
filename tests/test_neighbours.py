"""Nearest neighbours by cells against brute force."""

import numpy as np
import pytest

from folioflow.operators import neighbours, retrieval


def unit(v):
    return v / np.linalg.norm(v)


def table(spark, vectors, extra=None):
    rows = [(i, None if v is None else [float(x) for x in v], *(extra(i) if extra else ("en", "a"))) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, language string, role string")


def asked(passages, step):
    return passages.filter(f"chunk_id % {step} = 0").selectExpr("chunk_id query_id", "embedding vector", "language")


def brute(rows, step, k, on=False, by=False):
    usable = [r for r in rows if r["embedding"] is not None and any(r["embedding"])]
    out = set()
    for q in (r for r in usable if r["chunk_id"] % step == 0):
        near = {}
        for p in usable:
            if len(p["embedding"]) == len(q["embedding"]) and (not on or (q["language"] is not None and p["language"] == q["language"])):
                d = round(1 - float(unit(np.array(p["embedding"])) @ unit(np.array(q["embedding"]))), 9)
                near.setdefault(p["role"] if by else "", []).append((d, p["chunk_id"]))
        for v in near.values():
            out |= {(q["chunk_id"], c, i + 1) for i, (_, c) in enumerate(sorted(v)[:k])}
    return out


def clustered(rng, n, centres=40, size=24, spread=0.1):
    middle = rng.normal(size=(centres, size))
    return middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size))


def got(found):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in found.select("query_id", "chunk_id", "rank").collect()}


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_exact_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    vectors = list(clustered(rng, 400) if kind == "clustered" else rng.normal(size=(400, 24)))
    vectors[40:46] = [vectors[0]] * 6  # equal distances go by id
    extra = lambda i: (("en", "fr", None)[i % 3 if i % 7 else 0], ("a", "b", None)[i % 5 % 3])
    passages = table(spark, vectors, extra)
    rows = passages.collect()
    for on, by, block, few in (([], None, 64, 0), (["language"], None, 2048, 0), (["language"], ["role"], 16, 0), (["language"], ["role"], 16, 1000), ([], None, 2048, 400)):
        found = retrieval.search(passages, asked(passages, 20), on, 5, by, block=block, few=few)
        assert got(found) == brute(rows, 20, 5, bool(on), bool(by)), (on, by, few)


def test_vectors_without_a_direction_and_of_other_sizes(spark):
    vectors = [[1, 0], [0, 0], None, [1, 1], [1, 0, 0], [0, 1, 0], [float("nan"), 1], [0, 1]]
    passages = table(spark, vectors)
    for few in (0, neighbours.FEW):
        found = retrieval.search(passages, asked(passages, 1), [], 3, few=few)
        assert got(found) == brute(passages.filter("chunk_id != 6").collect(), 1, 3)
    assert retrieval.search(passages.limit(0), asked(passages, 1), [], 3).collect() == []
    assert retrieval.search(passages, asked(passages, 1).limit(0), [], 3).collect() == []


def test_far_cells_are_not_visited(spark):
    passages = table(spark, clustered(np.random.default_rng(2), 3000))
    queries = asked(passages, 100)
    found, visits = neighbours.exact(passages, queries, [], 5, block=64, few=0)
    blocks = lambda df: df.selectExpr("sum(blocks)").first()[0] or 0
    assert blocks(visits.live) < 0.1 * blocks(visits.possible)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == brute(passages.collect(), 100, 5)


def test_queries_that_meet_a_block_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    passages = table(spark, clustered(np.random.default_rng(3), 200, centres=5))
    assert got(retrieval.search(passages, asked(passages, 4), [], 3, block=20, few=0)) == brute(passages.collect(), 4, 3)


def test_approximate_search_recall_and_candidates(spark):
    """Recall at 5 of 0.9 or more from at most 15 % of all pairs."""
    rng = np.random.default_rng(4)
    passages = table(spark, clustered(rng, 3000, centres=60, size=32, spread=0.25))
    queries = asked(passages, 20)
    exact = {r[:2] for r in brute(passages.collect(), 20, 5)}
    cells = neighbours.learn_cells(passages)
    found, measured = neighbours.approximate(passages, queries, 5, probes=3, cells=cells)
    near = {(r["query_id"], r["id"]) for r in found.collect()}
    assert len(exact & near) / len(exact) >= 0.9
    placed = neighbours._place(passages.selectExpr("chunk_id id", "'' scope", "'' of", "embedding v"), cells, 2, True)
    visits = neighbours._asked(queries, cells, [], 3).join(neighbours._directory(placed, 2048), ["dim", "scope", "cell"])
    everything = 3000 * queries.count()
    assert visits.selectExpr("sum(n)").first()[0] <= 0.15 * everything
    assert measured.count() <= 0.02 * everything


def test_a_vector_that_many_passages_share(spark):
    passages = table(spark, [[1, 2, 3]] * 500 + [[3, 2, i % 9] for i in range(100)])
    assert got(retrieval.search(passages, asked(passages, 50), [], 4, block=32, few=0)) == brute(passages.collect(), 50, 4)


def test_small_scopes_have_few_cells_and_tasks_a_bounded_number_of_rows(spark, monkeypatch):
    """Visits follow full blocks, not the root of all rows; what a task sorts is bounded by their number."""
    rng = np.random.default_rng(4)
    passages = table(spark, rng.normal(size=(600, 8)), lambda i: (f"l{i % 4}", f"r{i % 3}"))
    queries = asked(passages, 20)
    _, visits = neighbours.exact(passages, queries, ["language"], 3, ["role"], block=64, few=0)
    assert visits.possible.count() <= queries.count() * 3 * 3  # 50 rows a group fill 3 cells at most
    monkeypatch.setattr(neighbours, "ROWS", 40)
    found, visits = neighbours.exact(passages, queries, ["language"], 3, ["role"], block=64, few=0)
    assert visits.possible.rdd.getNumPartitions() > 4
    assert got(found.withColumnRenamed("id", "chunk_id")) == brute(passages.collect(), 20, 3, True, True)
