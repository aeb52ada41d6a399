"""Index tables: idempotent replacement, deletion, constraints.

Every function takes and returns whole DataFrames (snapshots); the caller writes them.  Rows that
stay are told by a bitmap of the incoming keys and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmaps import without_keys
from ..schemas import COURSE_ROLES, OFFICIAL_ROLES


def latest(incoming: DataFrame, keys: list[str], order: str, first: str | None = None) -> DataFrame:
    """The last version of each key; of equal versions one row, by the column ``first`` if given."""
    by = [*([F.col(first)] if first else []), *(F.col(c) for c in sorted(incoming.columns) if c not in (*keys, order, first) and _sortable(incoming, c))]
    best = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *by)
    return incoming.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def _sortable(df: DataFrame, name: str) -> bool:
    return not df.schema[name].dataType.typeName().startswith("map")


def upsert_documents(current: DataFrame, incoming: DataFrame, order: str = "indexed_at", key: str = "external_id") -> DataFrame:
    """``current`` with every document of ``incoming`` put in or replaced whole; a replay changes nothing."""
    return put_documents(current, latest(incoming, [key], order), key)


def put_documents(current: DataFrame, fresh: DataFrame, key: str = "external_id") -> DataFrame:
    """The same for documents of which each key has one row."""
    return without_keys(current, fresh.select(key), key).unionByName(fresh, allowMissingColumns=False)


def replace_chunks(current: DataFrame, incoming_docs: DataFrame, incoming_chunks: DataFrame, key: str = "external_id") -> DataFrame:
    """All chunks of the incoming documents give way to the new ones."""
    docs = incoming_docs.select(key).distinct()
    return without_keys(current, docs, key).unionByName(incoming_chunks.join(docs, key, "left_semi"))


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame, key: str = "external_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents left, chunks left, asked ids with ``deleted``)."""
    asked = ids.select(key).distinct()
    there = docs.select(key).distinct().withColumn("_there", F.lit(True))
    flags = asked.join(there, key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("deleted"))
    return without_keys(docs, asked, key), without_keys(chunks, asked, key), flags


def check_keys(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(violation, external_id, n): doubled documents, doubled ordinals, gaps in ordinals."""
    doubled = docs.groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("DUPLICATE_DOCUMENT").alias("violation"), "external_id", "n")
    per_ordinal = chunks.groupBy("external_id", "ordinal").agg(F.count(F.lit(1)).alias("n"))
    repeated = per_ordinal.filter("n > 1").groupBy("external_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("DUPLICATE_ORDINAL").alias("violation"), "external_id", "n")
    gaps = (
        per_ordinal.groupBy("external_id")
        .agg((F.max("ordinal") + 1 - F.count(F.lit(1))).cast("long").alias("n"))
        .filter("n != 0")
        .select(F.lit("ORDINAL_GAP").alias("violation"), "external_id", "n")
    )
    return doubled.unionByName(repeated).unionByName(gaps)


def role_violation(role: Column, course_id: Column) -> Column:
    """Null if the role may go with the course, else the reason."""
    has_course = F.coalesce(course_id, F.lit("")) != ""
    return (
        F.when(role.isin(*COURSE_ROLES) & ~has_course, F.lit("COURSE_REQUIRED"))
        .when(role.isin(*OFFICIAL_ROLES) & has_course, F.lit("COURSE_FORBIDDEN"))
        .when(role.isNull() | ~role.isin(*COURSE_ROLES, *OFFICIAL_ROLES), F.lit("UNKNOWN_ROLE"))
    )


def validate_roles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``code``)."""
    coded = df.withColumn("code", role_violation(F.col("role"), F.col("course_id")))
    return coded.filter("code is null").drop("code"), coded.filter("code is not null")


def gate_embeddings(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(external_id, dimension, code): code is null where all passages have vectors of one size."""
    sizes = chunks.groupBy("external_id").agg(
        F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count_if(F.col("embedding").isNull()).alias("missing")
    )
    code = (
        F.when(F.col("low").isNull(), F.lit("NO_PASSAGE"))
        .when((F.col("low") != F.col("high")) | (F.col("missing") > 0), F.lit("MIXED_DIMENSIONS"))
    )
    return docs.select("external_id").distinct().join(sizes, "external_id", "left").select("external_id", F.col("high").alias("dimension"), code.alias("code"))


def _require_owner(df: DataFrame, owner: str) -> None:
    """Notebooks without an owner are refused before any plan is built on them."""
    if owner not in df.columns:
        raise ValueError(f"notebook rows need {owner}")
    if not df.filter(F.coalesce(F.trim(owner), F.lit("")) == "").isEmpty():
        raise ValueError(f"{owner} is empty in some notebook rows")


def upsert_notebook(
    docs: DataFrame, chunks: DataFrame, incoming_docs: DataFrame, incoming_chunks: DataFrame, owner: str = "student_account_id", order: str = "indexed_at"
) -> tuple[DataFrame, DataFrame]:
    """Replace in the private tables; the owner of a document is copied to all its chunks."""
    _require_owner(incoming_docs, owner)
    fresh = latest(incoming_docs, ["external_id"], order)
    owned = incoming_chunks.drop(owner).join(fresh.select("external_id", owner), "external_id").select(*chunks.columns)
    return upsert_documents(docs, fresh, order), replace_chunks(chunks, fresh, owned)


def delete_notebook(docs: DataFrame, chunks: DataFrame, requests: DataFrame, owner: str = "student_account_id") -> tuple[DataFrame, DataFrame]:
    """Delete where both the document and its owner match."""
    _require_owner(requests, owner)
    keys = ["external_id", owner]
    asked = requests.select(*keys).distinct()
    return docs.join(asked, keys, "left_anti"), chunks.join(asked, keys, "left_anti")


def list_notebook(docs: DataFrame, owner_id: str, subject: str | None = None, owner: str = "student_account_id") -> DataFrame:
    """A student's documents, newest first."""
    if not (owner_id or "").strip():
        raise ValueError("a notebook is listed for one owner")
    picked = docs.filter(F.col(owner) == owner_id)
    if subject:
        picked = picked.filter(F.col("subject") == subject)
    return picked.orderBy(F.col("indexed_at").desc(), "external_id")


def audit_index(docs: DataFrame, chunks: DataFrame, scope: list[str]) -> DataFrame:
    """Chunks and vector sizes by scope and model, and whether a scope mixes sizes or models."""
    sizes = docs.select("external_id", *scope, "embedding_model").join(chunks.select("external_id", F.size("embedding").alias("d")), "external_id")
    by_model = sizes.groupBy(*scope, "embedding_model").agg(F.count(F.lit(1)).alias("chunks"), F.min("d").alias("min_dimension"), F.max("d").alias("max_dimension"))
    w = Window.partitionBy(*scope)
    return by_model.withColumn("mixed_dimensions", F.min("min_dimension").over(w) != F.max("max_dimension").over(w)).withColumn(
        "several_models", F.min("embedding_model").over(w) != F.max("embedding_model").over(w)
    )


def chunk_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Count, median and maximum of tokens."""
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.percentile("token_count", F.lit(0.5)).alias("median_tokens"), F.max("token_count").alias("max_tokens"))
