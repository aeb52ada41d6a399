"""Mixing sources to target weights by nested hash thresholds.

Every row has a hash.  Words are summed by source and hash bucket; the running sum of a
source's buckets finds the bucket in which its budget ends; only that bucket is summed
again by the next bits of the hash, and again, until a bucket is a row or rows of one
hash.  A row is then taken or not by comparing its hash with its source's threshold: no
sort, and thresholds of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_columns
from .scratch import Scratch
from .text import word_counts

#: Bits of each of the three levels of buckets.
LEVEL_BITS = 12
LEVELS = 3


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    """Of id and text, so that rows without an id or of one id are told apart by their texts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - LEVEL_BITS * LEVELS)


def _key(source_col: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("n"))


def _bucket(level: int) -> Column:
    return F.shiftright("h", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND((1 << LEVEL_BITS) - 1)


def targets(totals: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """For each source (one row each: ``key``, ``source_size``) its target.

    Sources in order of code points, null last, weigh ``weights`` in turn and share all words
    by weight.  No target is above ``max_copies`` times its source; what is cut off goes to
    the others by weight.  In order of cap over weight the cut sources come first, so running
    sums over the table of sources give the final share directly.
    """
    rank = F.row_number().over(Window.orderBy(F.col("key") == "n", "key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    t = totals.select("key", "source_size", weight.alias("weight"), (F.lit(float(max_copies)) * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.select(
        "*",
        F.row_number().over(order).alias("at"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("share"),
    )
    t = t.withColumn("open", F.col("share") * F.col("weight") < F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct("at", "share"))).over(everything)
    t = t.withColumn("first", first)
    cut = F.col("first").isNull() | (F.col("at") < F.col("first.at"))
    return t.select(
        "key",
        "source_size",
        F.when(cut, F.col("cap")).otherwise(F.least(F.col("weight") * F.col("first.share"), F.col("cap"))).alias("target"),
    )


def thresholds(sized: DataFrame, plan: DataFrame, scratch: Scratch, max_copies: int) -> DataFrame:
    """``plan`` plus ``full`` (copies of every row) and ``cut`` (rows of a lower hash get one copy more, none where nothing more is needed)."""
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(F.lit(0))
    plan = plan.withColumn("full", full.cast("int"))
    plan = plan.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))).withColumn("cut", F.lit(0).cast("long"))
    plan = plan.withColumn("short", F.col("need") > 0)
    plan = scratch.save(plan, "plan0")
    for level in range(LEVELS):
        # rows that share the source's hash bits so far
        inside = F.shiftright("h", LEVEL_BITS * (LEVELS - level)) == F.col("cut")
        rows = sized.join(plan.select("key", "cut"), "key").filter(inside) if level else sized
        sums = rows.groupBy("key", _bucket(level).alias("b")).agg(F.sum("size").alias("w"))
        running = F.sum("w").over(Window.partitionBy("key").orderBy("b"))
        found = (
            sums.select("key", "b", "w", (running - F.col("w")).alias("below"))
            .join(plan.select("key", "need"), "key")
            .filter(F.col("below") <= F.col("need"))
            .groupBy("key")
            .agg(F.max(F.struct("b", "below", "w")).alias("at"))
        )
        last = level == LEVELS - 1
        rest = F.col("need") - F.coalesce(F.col("at.below"), F.lit(0))
        # of the last bucket all or nothing, whichever is nearer
        step = F.when(F.col("at.w").isNotNull() & (rest * 2 >= F.col("at.w")) & (rest > 0), F.lit(1)).otherwise(F.lit(0)) if last else F.lit(0)
        plan = scratch.save(
            plan.join(found, "key", "left").select(
                "key",
                "source_size",
                "target",
                "full",
                rest.alias("need"),
                "short",
                F.when(F.col("short"), F.col("cut") * (1 << LEVEL_BITS) + F.coalesce(F.col("at.b"), F.lit(0)) + step).otherwise(0).cast("long").alias("cut"),
            ),
            f"plan{level + 1}",
        )
        scratch.drop(f"plan{level}")
    return plan.drop("need", "short")


def size_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``size``: words of the text, 0 for null."""
    return append_columns(df, lambda b: [word_counts(b.column(text_col))], [T.StructField("size", T.LongType(), False)], text_col, (text_col,))


def mixture(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5, 2, 1),
    max_copies: int = 3,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): ``rows`` has id, key, h and size; ``plan`` one row for each source.

    Rows equal in id and text (or without an id and equal in text) share a decision.  Null
    sources are one source, the last.  Empty and null texts weigh nothing; a source of such
    texts alone has the target 0.  An empty table gives two empty tables.  ``plan`` is made by
    windows over one row a source.  Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    picked = df.select(F.col(id_col).alias("id"), _key(source_col).alias("key"), _hash(id_col, text_col, seed).alias("h"), F.col(text_col).alias("text"))
    sized = scratch.save(size_rows(picked), "sized")
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    plan = thresholds(sized, targets(totals, weights, max_copies), scratch, max_copies)
    return sized, plan


def copies() -> Column:
    return F.col("full") + F.when(F.col("h") < F.col("cut"), F.lit(1)).otherwise(F.lit(0))


def mix_report(df: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken (words the mix takes)."""
    sized, plan = mixture(df, **options)
    return sized.join(plan, "key").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken")
    )


def mix_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11, **options) -> DataFrame:
    """The rows of the mix, all columns whatever their names, each as often as the mix takes it: never more than ``max_copies`` times."""
    _, plan = mixture(df, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **options)
    names = df.columns
    tagged = df.select(F.struct(*names).alias("row"), _key(source_col).alias("key"), _hash(id_col, text_col, seed).alias("h"))
    n = F.explode(F.when(copies() > 0, F.sequence(F.lit(1), copies())).otherwise(F.array().cast("array<int>")))
    return tagged.join(plan, "key").select("row", n.alias("copy")).select("row.*")
