"""Nearest neighbours by cosine distance over cells of vectors.

Directions are dealt to cells, each round a centre; the centres are learnt on a bounded sample
and are few, so they travel with the tasks.  Passages of one scope and cell form blocks of a
bounded number of rows, and a block meets the queries that visit it in one matrix product.

Exact search: a query visits the nearest cell that can fill its k places; the k-th distance found
there excludes every cell whose members must all be further away, by the triangle inequality
for angles.  What is left is visited.  Approximate search: a query visits so many nearest cells,
compares one byte a dimension, and only its best candidates are measured exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, norm
from ..scratch import saved

#: Vectors on which centres are learnt, and cells, at most.
SAMPLE = 16_384
MOST_CELLS = 1024
#: Passages of a block, and queries that meet it at once, about.
BLOCK = 2048
#: Passages that are met whole: bounds for so few blocks cost more than they exclude.
FEW = 4 * BLOCK
QUERIES = 50_000
#: Members of a block, about, where scopes are small: of smaller ones each query would visit very many.
FULL = 4
#: Rows of a task, about: its vectors and visits are sorted in memory.
ROWS = 100_000
_KEYS = ["dim", "scope", "of", "cell", "split", "part"]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: not null, no null or NaN in it, of a length over zero."""
    size = norm(F.col(vector))
    return df.filter((size > 0) & (size < float("inf")))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors as rows; all of one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1, 1))


@dataclass(frozen=True)
class Cells:
    """Centres by number of dimensions; without any, all vectors are in one cell."""

    centres: dict[int, np.ndarray]

    def by_size(self, batch: pa.RecordBatch, vector: str):
        """(rows, unit vectors, their angles to the centres) for each number of dimensions in a batch."""
        sizes = np.array([len(v) for v in batch.column(vector)], np.int64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            units = _matrix(batch.column(vector).take(pa.array(rows)))
            centres = self.centres.get(size, np.eye(1, size))
            yield rows, units, _angles(units, centres)


def learn_cells(passages: DataFrame, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, rounds: int = 8, seed: int = 3) -> Cells:
    """Centres by spherical k-means on about ``sample`` vectors of each number of dimensions; by default the square root of the rows, ``MOST_CELLS`` at most."""
    rows = usable(passages, vector).select(F.col(vector).alias("v"), F.size(vector).alias("dim"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a number of dimensions
    centres = {}
    for dim, n in counts.items():
        chance = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30)) * n < sample * (1 << 30)
        some = _matrix(rows.filter((F.col("dim") == dim) & chance).select("v").distinct().toArrow().column("v"))
        wanted = min(cells or max(1, round(n**0.5)), MOST_CELLS, max(len(some), 1))
        some = some[np.lexsort(some.T)] if len(some) else np.eye(1, dim)
        found = some[np.random.default_rng(seed).permutation(len(some))[:wanted]]
        for _ in range(rounds):
            home = (some @ found.T).argmax(axis=1)
            sums = np.zeros_like(found)
            np.add.at(sums, home, some)
            size = np.sqrt((sums * sums).sum(axis=1))
            found = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], found)
        centres[dim] = found
    return Cells(centres)


def _scope(columns: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))) if columns else F.lit("")


def _place(df: DataFrame, cells: Cells, homes: int, codes: bool) -> DataFrame:
    """(id, scope, of, dim, cell, angle, v): each vector in its nearest cells; ``v`` is the vector or its one-byte code."""

    def run(batches):
        for batch in batches:
            for rows, units, angles in cells.by_size(batch, "v"):
                near = np.argsort(angles, axis=1, kind="stable")[:, :homes]
                at = np.repeat(np.arange(len(rows)), near.shape[1])
                picked = batch.take(pa.array(rows[at]))
                v = pa.array([np.rint(u / np.abs(u).max() * 127).astype(np.int8).tobytes() for u in units]).take(pa.array(at)) if codes else picked.column("v")
                numbers = pa.array(np.full(len(at), units.shape[1], np.int32)), pa.array(near.ravel().astype(np.int32)), pa.array(angles[at, near.ravel()])
                yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in ("id", "scope", "of")), *numbers, v], names=["id", "scope", "of", "dim", "cell", "angle", "v"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, f"id {kinds['id']}, scope string, of string, dim int, cell int, angle double, v {'binary' if codes else kinds['v']}")


def _asked(queries: DataFrame, cells: Cells, on: list[str], probes: int | None, tasks: int = 1) -> DataFrame:
    """(query_id, scope, dim, cell, angle): one row for each cell that a query may visit, the nearest ``probes`` or all."""
    rows = usable(queries, "vector").filter(_known(on)).select("query_id", _scope(on).alias("scope"), F.col("vector").alias("v"))
    rows = rows.repartition(tasks) if tasks > 1 else rows

    def run(batches):
        for batch in batches:
            for rows, units, angles in cells.by_size(batch, "v"):
                near = np.argsort(angles, axis=1, kind="stable")[:, :probes]
                step = max(1, (1 << 16) // near.shape[1])
                for lo in range(0, len(rows), step):
                    some = near[lo : lo + step]
                    at = np.repeat(np.arange(lo, lo + len(some)), some.shape[1])
                    picked = batch.select(["query_id", "scope"]).take(pa.array(rows[at]))
                    numbers = pa.array(np.full(len(at), units.shape[1], np.int32)), pa.array(some.ravel().astype(np.int32)), pa.array(angles[at, some.ravel()])
                    yield pa.RecordBatch.from_arrays([*picked.columns, *numbers], names=["query_id", "scope", "dim", "cell", "angle"])

    return rows.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, scope string, dim int, cell int, angle double")


def _known(on: list[str]) -> Column:
    """Rows whose scope has no null, which equals nothing."""
    out = F.lit(True)
    for c in on:
        out &= F.col(c).isNotNull()
    return out


def _directory(placed: DataFrame, block: int) -> DataFrame:
    """Rows, nearest and furthest angle and number of blocks of each scope and cell."""
    return placed.groupBy("dim", "scope", "of", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer")).withColumn("blocks", F.expr(f"cast((n + {block - 1}) div {block} as int)"))


def _tasks(directory: DataFrame, asking: int, parts: int = 1) -> int:
    """Tasks of about ``ROWS`` rows if so many queries visit every block of their scope: the adaptive size counts packed bytes, and repeated vectors pack well."""
    scopes = directory.groupBy("dim", "scope").agg(F.sum("blocks").alias("blocks"), F.sum("n").alias("n"))
    most = scopes.agg(F.max("blocks").alias("blocks"), F.sum("n").alias("n")).first()
    return 1 + max(asking * (most["blocks"] or 0), parts * (most["n"] or 0)) // ROWS


def _meet(placed: DataFrame, directory: DataFrame, visits: DataFrame, queries: DataFrame, k: int, codes: bool) -> DataFrame:
    """(query_id, of, id, distance): the k nearest of each query in each block that it visits; ``visits`` has query_id and the cell's key."""
    count = queries.count()
    parts = 1 + count // QUERIES  # a block meets a part of the queries at once
    tasks = _tasks(directory, count, parts)
    key = ["dim", "scope", "of", "cell"]
    split = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = placed.join(directory.select(*key, "blocks"), key).select(*key, split.alias("split"), every.alias("part"), "id", "v")
    asking = visits.join(queries.select("query_id", F.col("vector").alias("v")), "query_id")
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    right = asking.select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("split"), part.alias("part"), "query_id", "v")
    if tasks > 1:
        left, right = left.repartition(tasks, *_KEYS), right.repartition(tasks, *_KEYS)

    def members_of(table: pa.Table) -> np.ndarray:
        if not codes:
            return _matrix(table.column("v"))
        m = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int8).astype(float).reshape(table.num_rows, -1)
        return m / np.sqrt((m * m).sum(axis=1))[:, None]

    def nearest(these: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if these.num_rows and asking.num_rows:
            these = these.sort_by("id")  # so that equal distances go by id
            members, vectors = members_of(these), _matrix(asking.column("v"))
            most = min(k, len(members)) - 1
            for lo in range(0, len(vectors), 1024):
                d = 1 - vectors[lo : lo + 1024] @ members.T
                near = np.round(d, 9)
                row, col = np.nonzero(near <= np.partition(near, most, axis=1)[:, most, None])
                order = np.lexsort((col, near[row, col], row))
                row, col = row[order], col[order]
                row, col = (x[np.arange(len(row)) - np.searchsorted(row, row) < k] for x in (row, col))
                found.append((pa.array(row + lo), pa.array(col), pa.array(d[row, col])))
        query, member, distance = (pa.concat_arrays([f[i] for f in found]) if found else pa.array([], (pa.int64(), pa.int64(), pa.float64())[i]) for i in range(3))
        return pa.table({"query_id": asking.column("query_id").take(query), "of": these.column("of").take(member), "id": these.column("id").take(member), "distance": distance})

    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["query_id"]
    return left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(nearest, f"query_id {kinds[1]}, of string, id {kinds[0]}, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    from .retrieval import rank_nearest

    return rank_nearest(found, ["query_id", "of"], k, tie="id")


@dataclass(frozen=True)
class Visits:
    """Cells that queries visit in an exact search; ``live`` are those after the first that the bound doesn't exclude."""

    possible: DataFrame
    live: DataFrame


def exact(passages: DataFrame, queries: DataFrame, on: list[str], k: int, by: list[str] | None = None, cells: Cells | None = None, block: int = BLOCK, few: int = FEW) -> tuple[DataFrame, Visits]:
    """(query_id, of, id, distance, rank) of the k nearest passages of each query and value of ``by``, and the visits.

    ``passages``: chunk_id (unique), embedding and the columns ``on`` and ``by``; ``queries``: query_id
    (unique), vector and ``on``.  There are no more cells than a scope and value of ``by`` fill with
    a ``FULL``th of a block each.  Vectors without a direction and scopes with a null find nothing;
    vectors of different sizes never meet; distances equal to nine digits go by id.  Up to ``few``
    passages are one cell, whose blocks all queries of their scope visit.
    """
    whole = cells is None and usable(passages, "embedding").limit(few + 1).count() <= few
    if cells is None and not whole:
        sizes = usable(passages, "embedding").filter(_known(on)).groupBy(_scope(on), _scope(by or [])).agg(F.count(F.lit(1)).alias("n"))
        held = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).first()
        fill = (held["n"] or 0) // max(1, held["groups"] * (block // FULL))
        cells = learn_cells(passages, cells=max(1, min(fill, round((held["n"] or 0) ** 0.5))))
    cells = cells or Cells({})
    rows = usable(passages, "embedding").filter(_known(on)).select(F.col("chunk_id").alias("id"), _scope(on).alias("scope"), _scope(by or []).alias("of"), F.col("embedding").alias("v"))
    placed = saved(_place(rows, cells, 1, False), "placed")
    directory = saved(_directory(placed, block), "cells")
    tasks = _tasks(directory, queries.count())
    possible = _asked(queries, cells, on, None, tasks).join(directory, ["dim", "scope", "cell"])
    possible = possible.repartition(tasks, "query_id", "of") if tasks > 1 else possible
    if whole:
        return _best(_meet(placed, directory, possible, queries, k, False), k), Visits(possible, possible)
    # of those that hold k passages the nearest cell, else the nearest
    home = possible.groupBy("query_id", "of").agg(F.min(F.struct(F.col("n") < k, "angle", "cell", "dim", "scope", "blocks")).alias("home"))
    home = home.select("query_id", "of", "home.cell", "home.dim", "home.scope", "home.blocks")
    first = saved(_best(_meet(placed, directory, home, queries, k, False), k), "first")
    bound = first.filter(F.col("rank") == k).select("query_id", "of", F.col("distance").alias("kth"))
    # no member is nearer than this angle; the slack covers rounding
    apart = F.greatest(F.col("angle") - F.col("outer"), F.col("inner") - F.col("angle"), F.lit(1e-6)) - 1e-6
    other = possible.join(home.select("query_id", "of", F.col("cell").alias("seen")), ["query_id", "of"]).filter("cell != seen").join(bound, ["query_id", "of"], "left")
    live = other.filter(F.col("kth").isNull() | (1 - F.cos(apart) <= F.col("kth") + 1e-8))
    second = _meet(placed, directory, live, queries, k, False)
    return _best(first.drop("rank").unionByName(second), k), Visits(possible, live)


def approximate(passages: DataFrame, queries: DataFrame, k: int, homes: int = 2, probes: int | None = 8, keep: int = 10, cells: Cells | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, distance, rank) of about the k nearest, and the pairs that were measured exactly.

    Each passage lies in its ``homes`` nearest cells, a query visits its ``probes`` nearest (None: all);
    blocks hold one byte a dimension, ``keep * k`` candidates of each query are measured exactly.
    """
    cells = cells or learn_cells(passages)
    rows = usable(passages, "embedding").select(F.col("chunk_id").alias("id"), F.lit("").alias("scope"), F.lit("").alias("of"), F.col("embedding").alias("v"))
    placed = saved(_place(rows, cells, homes, True), "codes")
    directory = saved(_directory(placed, block), "cells")
    visits = _asked(queries, cells, [], probes).join(directory, ["dim", "scope", "cell"])
    met = _meet(placed, directory, visits, queries, keep * k, True)
    rough = met.groupBy("query_id", "of", "id").agg(F.min("distance").alias("distance"))
    pairs = saved(_best(rough, keep * k).select("query_id", "of", "id"), "candidates")
    near = pairs.join(passages.select(F.col("chunk_id").alias("id"), "embedding"), "id").join(queries.select("query_id", "vector"), "query_id")
    near = near.select("query_id", "of", "id", cosine_distance(F.col("embedding"), F.col("vector")).alias("distance"))
    return _best(near, k).drop("of"), pairs
