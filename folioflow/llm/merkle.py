"""Merkle manifests: a digest tree over the rows of each part of a table, and every row's proof.

Rows are ranked within their part, runs of ``FAN`` digests become the digest of a parent until
one subroot is left, and subroots become one root in the same way.  Proofs come by pointer
jumping: each inner node holds its siblings (what stands left and right of it) and a pointer to
its parent; a self-join of that table doubles the distance of every pointer and concatenates the
segments, until every node has reached the root; rows then take up the proof of their parent.

The rows' own texts are hashed where they are read; only digests are shuffled.  No part is ordered
in one task: ranks are counts of earlier ranges plus a rank inside the row's own range.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sharding import _running, in_ranges

#: Digests that make one parent.
FAN = 8
#: Pointers to levels of at most so many nodes in all are followed by a broadcast: near the root few nodes have many rows below.
NEAR = 4096
_SEGMENTS = "array<struct<left:binary,right:binary>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """Digest of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def joint_digest(digests: Column) -> Column:
    """Digest of concatenated digests, which go in as lower-case hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda held, run: joint_digest(F.concat(run["left"], held, run["right"])))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right; of nothing where there are none."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.lower(F.concat(F.hex(run["left"]), F.hex(run["right"])))), ""), 256)


def _ceiling(n: Column, level: int) -> Column:
    """Nodes at a level of a tree of n leaves."""
    return F.expr(f"(n + {FAN**level - 1}L) div {FAN**level}L") if FAN**level < 1 << 62 else F.lit(1).cast("long")


def _height(n: int) -> int:
    """Level of the last node; leaves that stand alone count as nodes of level 1."""
    level = 1
    while FAN**level < n:
        level += 1
    return level


def _joined(children: Column) -> Column:
    return F.unhex(F.array_join(F.transform(children, lambda c: F.hex(c["digest"])), ""))


def _split(at: Column) -> Column:
    """What stands left and right of a child among the ``joined`` digests of its run."""
    return F.struct(
        F.substring("joined", F.lit(1), at * 32).alias("left"),
        F.substring("joined", at * 32 + 33, F.lit(FAN * 32)).alias("right"),
    )


@dataclass
class _Forest:
    """Runs of leaves (tree, n, up, children, joined), runs of inner nodes by level, and the last node of each tree."""

    leaves: DataFrame
    runs: dict[int, DataFrame]
    subroots: DataFrame  # tree, level, digest
    width: dict[int, int]  # nodes by level, all trees together


def _grow(leaves: DataFrame, scratch: Scratch, name: str) -> _Forest:
    """``leaves``: tree, at (their order), digest and anything else."""
    ranges = scratch.save(in_ranges(leaves, ["tree", "at", "digest"]), f"{name}_ranges")
    ahead = _running(ranges.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n")), ["tree"], "part")
    row = F.row_number().over(Window.partitionBy("part", "tree").orderBy("at", "digest"))
    placed = ranges.join(ahead, ["part", "tree"]).withColumn("idx", F.col("below") + row - 1).withColumnRenamed("total", "n")
    carried = [c for c in leaves.columns if c not in ("tree", "digest")]

    def runs(nodes: DataFrame, more: list[str]) -> DataFrame:
        kept = F.sort_array(F.collect_list(F.struct("idx", "digest", *more)))
        return nodes.groupBy("tree", "n", F.expr(f"idx div {FAN}").alias("up")).agg(kept.alias("children")).withColumn("joined", _joined(F.col("children")))

    first = scratch.save(runs(placed, carried), f"{name}_leaves")
    scratch.drop(f"{name}_ranges")
    sizes = first.filter("up = 0").select("n")
    top = _height(sizes.agg(F.max("n")).first()[0] or 1)
    there = {level: F.when((_ceiling(F.col("n"), level - 1) > 1) | F.lit(level == 1), _ceiling(F.col("n"), level)).otherwise(0) for level in range(1, top + 1)}
    width = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(str(level)) for level, c in there.items())).first().asDict()  # one row
    alone = F.when(F.col("n") == 1, F.col("joined")).otherwise(joint_digest(F.col("joined")))
    nodes, inner, ends = first.select("tree", "n", F.col("up").alias("idx"), alone.alias("digest")), {}, []
    for level in range(1, top + 1):
        ends.append(nodes.filter(_ceiling(F.col("n"), level) == 1).select("tree", F.lit(level).alias("level"), "digest"))
        if level < top:
            inner[level] = scratch.save(runs(nodes.filter(_ceiling(F.col("n"), level) > 1), []), f"{name}_runs{level}")
            nodes = inner[level].select("tree", "n", F.col("up").alias("idx"), joint_digest(F.col("joined")).alias("digest"))
    return _Forest(first, inner, scratch.save(reduce(DataFrame.unionByName, ends), f"{name}_subroots"), {int(k): v for k, v in width.items()})


def _climb(forest: _Forest, ends: DataFrame, scratch: Scratch, name: str, near: int) -> DataFrame:
    """(tree, up, path, ended): of each node of level 1 all siblings up to the root.

    ``ends``: tree, path (from the tree's last node to the root) and ``ended`` (not null).  A pointer's
    distance doubles in each round, so the rounds are known from the height.
    """
    top = max(forest.width)
    # the highest levels that hold at most `near` nodes in all; levels below are joined by shuffles, where a node has a small share of rows
    first_near = next(level for level in range(1, top + 2) if sum(forest.width[k] for k in range(level, top + 1)) <= near)
    kind = dict(ends.dtypes)["ended"]
    hops = [
        runs.select("tree", "up", "joined", F.posexplode("children").alias("at", "child")).select(
            "tree",
            F.lit(level).alias("level"),
            F.col("child.idx").alias("idx"),
            F.lit(level + 1).alias("to_level"),
            F.col("up").alias("to_idx"),
            F.array(_split(F.col("at"))).cast(_SEGMENTS).alias("path"),
            F.lit(None).cast(kind).alias("ended"),
        )
        for level, runs in forest.runs.items()
    ]
    last = forest.subroots.join(ends, "tree").select(
        "tree", "level", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("int").alias("to_level"), F.lit(None).cast("long").alias("to_idx"), F.col("path").cast(_SEGMENTS).alias("path"), "ended"
    )
    table = scratch.save(reduce(DataFrame.unionByName, [*hops, last]), f"{name}_hops0")
    for k in range((top - 1).bit_length()):
        lowest = 1 + (1 << k)
        goals = table.filter(F.col("level") >= lowest).select(
            "tree", F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("to_level").alias("next_level"), F.col("to_idx").alias("next_idx"), F.col("path").alias("rest"), F.col("ended").alias("end")
        )
        live = table.filter("ended IS NULL").drop("ended")
        is_near = F.col("to_level") >= first_near
        met = live.filter(is_near).join(F.broadcast(goals.filter(is_near)), ["tree", "to_level", "to_idx"])  # at most `near` rows
        if lowest < first_near:
            met = met.unionByName(live.filter(~is_near).join(goals.filter(~is_near), ["tree", "to_level", "to_idx"]))
        met = met.select("tree", "level", "idx", F.col("next_level").alias("to_level"), F.col("next_idx").alias("to_idx"), F.concat("path", "rest").alias("path"), F.col("end").alias("ended"))
        parts = [table.filter("ended IS NOT NULL"), met]
        table = scratch.save(reduce(DataFrame.unionByName, parts), f"{name}_hops{k + 1}")
        scratch.drop(f"{name}_hops{k}")
    return table.filter("level = 1").select("tree", F.col("idx").alias("up"), "path", "ended")


def _with_paths(forest: _Forest, climbed: DataFrame) -> DataFrame:
    """Leaves with their whole path: the siblings in their own run, then those of their parent."""
    rows = forest.leaves.join(climbed, ["tree", "up"]).select("tree", "n", "path", "ended", "joined", F.posexplode("children").alias("at_run", "child"))
    own = F.when(F.col("n") > 1, F.array(_split(F.col("at_run")))).otherwise(F.array()).cast(_SEGMENTS)
    return rows.select("tree", "child.*", F.concat(own, "path").alias("path"), "ended")


def proofs(leaves: DataFrame, part: Column, order: Column, digest: Column, carry: dict[str, Column] | None = None, near: int = NEAR) -> DataFrame:
    """``carry``, leaf, subroot, root (32 bytes each) and path of each row; ``path`` holds what stands left and right, level by level.

    ``part``: text that names the row's tree (null: a tree of its own, which comes first);
    ``order``: the order of leaves in a tree (null first), ties by digest; rows equal in both are
    interchangeable.  Trees of one row have that leaf as subroot.  An empty table gives no rows.
    Only the named columns are read, whatever others are called.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("v"), part.cast("string")), F.lit("n"))  # n before v, so null first
    rows = leaves.select(tree.alias("tree"), order.alias("at"), digest.alias("digest"), F.struct(*(c.alias(k) for k, c in carry.items()), F.lit(0).alias("_")).alias("row"))
    forest = _grow(rows, scratch, "rows")
    over = _grow(forest.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("at"), "digest"), scratch, "parts")
    none = F.array().cast(_SEGMENTS)
    climbed = _climb(over, over.subroots.select("tree", none.alias("path"), F.col("digest").alias("ended")), scratch, "parts", near)
    tops = _with_paths(over, climbed).select(F.col("at").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("ended").alias("root")).alias("ended"))
    climbed = _climb(forest, scratch.save(tops, "tops"), scratch, "rows", near)
    return _with_paths(forest, climbed).select(*(F.col("row")[k].alias(k) for k in carry), F.col("digest").alias("leaf"), "ended.subroot", "ended.root", "path")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle_report(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Per row: doc_id, its leaf, subroot and root, the digest of its proof, the root that its tampered self leads to and whether that is the root.

    Texts of rows whose crc32(doc_id) is divisible by 3 are tampered with: A-Z lower-cased.  A null
    doc_id comes first in its tree and isn't tampered with; repeated ids are ordered by leaf; null
    and empty texts differ; whole texts are hashed.  An empty table gives no rows.
    """
    digest = lambda text: row_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, digest(F.translate("text", UPPER, LOWER)))
    out = proofs(docs, F.col("lang"), F.col("doc_id"), digest(F.col("text")), {"doc_id": F.col("doc_id"), "tampered": tampered}, near)
    text = lambda c: F.lower(F.hex(c))
    out = out.select("doc_id", *(text(c).alias(c) for c in ("leaf", "subroot", "root")), path_digest(F.col("path")).alias("proof_sha256"), text(fold(F.coalesce("tampered", "leaf"), F.col("path"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
