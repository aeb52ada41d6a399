"""Whole jobs composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, cleaning, quality, review, tables
from ..operators.embedding import Encoder, embed
from ..scratch import saved


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """A stable id, so that reruns replace rather than add."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("\x01", "external_id", F.col("ordinal").cast("string")), 256))


def index_corpus(docs: DataFrame, chunks: DataFrame, incoming: DataFrame, encoder: Encoder, model: str, order: str = "indexed_at", **sizes) -> dict[str, DataFrame]:
    """Validate, chunk, embed, gate and replace: new ``documents`` and ``chunks``, and what was ``rejected`` with its code."""
    # each is read by several branches: ranked, cut and embedded once
    valid, wrong_role = tables.validate_roles(saved(tables.latest(incoming, ["external_id"], order), "incoming"))
    made = saved(embed(chunk_ids(chunking.chunk_corpus(valid, **sizes)), "content", encoder), "embedded")
    gated = saved(tables.gate_embeddings(valid, made), "gated")
    counted = made.groupBy("external_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    passed = saved(gated.filter("code is null").select("external_id", F.col("dimension").alias("embedding_dimension")).join(counted, "external_id"), "passed")
    fresh = (
        valid.drop("embedding_dimension", "embedding_model", "chunk_count", "characters")
        .join(passed, "external_id")
        .withColumn("embedding_model", F.lit(model))
        .withColumn("characters", F.char_length("content"))
    )
    rejected = wrong_role.select("external_id", "code").unionByName(gated.filter("code is not null").select("external_id", "code"))
    return {
        "documents": tables.put_documents(docs, fresh.select(*docs.columns)),
        "chunks": tables.replace_chunks(chunks, passed, made.select(*chunks.columns)),
        "rejected": rejected,
    }


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, position, heading_path, text): stretches of a cleaned document below their headings."""
    return chunking.split_blocks(docs, id_col, text_col)


def inspect_corpus(docs: DataFrame) -> dict[str, DataFrame]:
    """Clean, cut into sections, find doubtful passages: ``sections`` with confidence, ``issues`` and their ``summary``."""
    # each is read by several branches: cleaned, cut and searched once
    made = sections(cleaning.clean_corpus(docs)).withColumn("section_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("position").cast("string")))
    cut = saved(made, "sections")
    found = saved(quality.issues(cut, "section_id"), "issues")
    sure = quality.section_confidence(cut, found, "section_id")
    distinct = quality.distinct_issues(found, "section_id")
    graded = cut.join(sure, "section_id").withColumn("needs_review", F.col("confidence") < 0.8)
    by_doc = distinct.join(cut.select("section_id", "doc_id"), "section_id")
    return {"sections": graded, "issues": distinct, "summary": quality.issue_summary(by_doc, "doc_id")}


def audit_courses(quizzes: DataFrame, sections: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """Certain findings (contradicted quizzes, unbalanced formulas) and reviewers' findings whose quote stands in the course.

    ``findings``: finding_id, course_id, severity, quote.  Others are returned with the code AUDIT_QUOTE_NOT_FOUND.
    """
    contradicted = review.contradicted_quizzes(quizzes)
    broken = review.text_damage(sections, "content").filter("formula_orphans > 0").select("course_id", "section_id", "formula_orphans")
    places = saved(review.finding_places(findings, sections), "places")
    held = places.select("finding_id").distinct()
    kept = findings.join(held, "finding_id", "left_semi")
    placed = kept.join(review.attribute_findings(kept, sections, places), "finding_id")
    lost = findings.join(held, "finding_id", "left_anti").withColumn("code", F.lit("AUDIT_QUOTE_NOT_FOUND"))
    return {"quizzes": contradicted, "formulas": broken, "findings": placed, "not_found": lost}


def redact_logs(df: DataFrame, attributes: str, sensitive: list[str]) -> DataFrame:
    """Mask sensitive keys of a map column, and bearer and session tokens in its values."""
    hidden = F.array(*map(F.lit, sensitive))
    masked = lambda k, v: F.when(F.array_contains(hidden, F.lower(k)), F.lit("[REDACTED]")).otherwise(
        F.regexp_replace(F.regexp_replace(v, "(?i)bearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"), "(?i)(session(?:_?id)?=)[A-Za-z0-9._-]+", "$1[REDACTED]")
    )
    return df.withColumn(attributes, F.transform_values(attributes, masked))
