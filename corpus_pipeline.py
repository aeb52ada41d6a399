"""A training-data pipeline over ``documents``: each stage reads what its predecessor kept.

toxicity -> near duplicates -> secrets -> mixing -> BPE
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, jaccard, mixing, secrets, toxicity
from folioflow.llm.scratch import Scratch

#: Learnt weights and token ids are no SQL, so the stages are tested against brute force.
ORACLE_SQL = None


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Null and empty texts stay; equal texts share a decision; columns keep their names whatever
    they are.  An empty table stays empty.
    """
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    The row of the smallest id stays, rows without an id come last; of repeated rows one stays,
    and of rows that share an id those of other groups.  Texts without words all stay.
    """
    return jaccard.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret in a text is replaced by its kind, and n_chars follows.

    Null and empty texts, repeated rows and columns of any name stay as they are.  An empty table
    stays empty.
    """
    spans = next(n for n in (f"_secrets{i}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    found = secrets.redact(secrets.scan(docs, out=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: not at all, or up to three times.

    Null sources are one source; texts without words weigh nothing and go with their hash;
    rows equal in id and text share a decision.  All columns stay.  An empty table stays empty.
    """
    return mixing.mix_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each row, and whether the ids decode to the text.

    Null texts count as empty and give no ids; repeated rows stay; other columns go.  An empty
    table gives no rows.
    """
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", civil),
    ("ngram_jaccard", unlike),
    ("secret_scan", redacted),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*read)
        read = (name,)
    return docs
