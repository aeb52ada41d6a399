"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in the order of a seeded hash; (rank - 1/2) / rows
of the source places them on the unit interval; cutting the rows in that order into equal
runs gives shards that all hold the mixture of sources.

No source is sorted in one task: ranks are counts of lower hash buckets plus a rank inside
the row's own bucket.  Positions alike, over ranges of the whole order: equal fractions
(sources of one row all stand at 1/2) are cut by source and hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Buckets of the hash within a source.
BUCKET_BITS = 12


def _running(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """``below`` (rows in lower buckets) and ``total`` for each bucket; one row a bucket, so small."""
    w = Window.partitionBy(*by)
    return counts.select(*by, bucket, (F.sum("n").over(w.orderBy(bucket)) - F.col("n")).alias("below"), F.sum("n").over(w).alias("total"))


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``part``, the number of the row's range in this order; to be saved before it is read twice."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", carry: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """id, ``carry`` columns, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Row counts of shards differ by one at most.  Null sources are a source of their own; rows
    without an id, or of one id, are told apart by their carried columns, and rows equal in all
    of these are interchangeable.  Columns that are not named are not read.  An empty table
    gives no rows.
    """
    scratch = Scratch(df.sparkSession, "sharding")
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("n")).alias("key"),
        F.xxhash64(F.lit(seed), F.col(id_col), *carry).alias("h"),
        *carry,
    ).withColumn("b", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    ties = [*(c for c in ("h", "id", *carry))]
    ahead = _running(rows.groupBy("key", "b").agg(F.count(F.lit(1)).alias("n")), ["key"], "b")
    ranked = (
        rows.join(ahead, ["key", "b"])
        .withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("key", "b").orderBy(*ties)))
        .withColumn("at", (F.col("rank") - 0.5) / F.col("total"))
        .select("id", "key", "h", *carry, "at")
    )
    order = ["at", "key", *ties]
    ranked = scratch.save(in_ranges(scratch.save(ranked, "ranked"), order), "ranges")
    scratch.drop("ranked")
    # one row a range, so a broadcast of bounded size
    ahead = F.broadcast(_running(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], "part"))
    place = F.col("below") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return (
        ranked.join(ahead, "part")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"place * {shards} div total"))
        .select("id", *carry, F.col("shard").cast("int").alias("shard"), F.expr(f"place - (shard * total + {shards - 1}) div {shards}").alias("slot"))
    )


def shard_report(df: DataFrame, shards: int = 16) -> DataFrame:
    """Per row: doc_id, size, text_crc32 and its place under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    sized = df.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(sized, shards, carry=("size", "text_crc32")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
