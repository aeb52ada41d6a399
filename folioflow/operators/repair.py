"""Repair of student notes by proof: a line changes only where a validated passage says nearly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Cosine distances: a proof at most, and so near that nothing is to correct.
PROOF, IDENTICAL = 0.18, 0.02
#: What became of a line.
UNCHANGED, CORRECTED, TO_CHECK = "inchange", "corrige", "a-verifier"


def split_segments(notes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal from 1, original): lines of a note, trimmed, blank ones dropped."""
    kept = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
    return notes.select(id_col, F.posexplode(kept).alias("n", "original")).select(id_col, (F.col("n") + 1).alias("ordinal"), "original")


def line_status(original: Column, proof: Column, distance: Column) -> Column:
    near = F.coalesce(distance <= PROOF, F.lit(False))
    same = (distance <= IDENTICAL) | (tx.same_text_key(original) == tx.same_text_key(proof))
    return F.when(near & same, UNCHANGED).when(near, CORRECTED).when(tx.broken_reason(original) != "", TO_CHECK).otherwise(UNCHANGED)


def repair(segments: DataFrame, proofs: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with status, text and reason.  ``proofs``: keys, proof_text, distance (one a segment)."""
    joined = segments.join(proofs, keys, "left")
    status = line_status(F.col("original"), F.col("proof_text"), F.col("distance"))
    out = joined.withColumn("status", status)
    return out.withColumn("text", F.when(F.col("status") == CORRECTED, F.col("proof_text")).otherwise(F.col("original"))).withColumn(
        "reason", F.when(F.col("status") == TO_CHECK, tx.broken_reason(F.col("original"))).otherwise(F.lit(""))
    )


def repair_report(segments: DataFrame, notes: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, segments, corrected, to_check, sources, warnings); notes without a line say so.

    Sources are those of corrections, distinct, in order of first use.
    """
    counted = segments.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.col("status") == CORRECTED).alias("corrected"),
        F.count_if(F.col("status") == TO_CHECK).alias("to_check"),
        F.sort_array(F.collect_list(F.when((F.col("status") == CORRECTED) & F.col(source_col).isNotNull(), F.struct("ordinal", F.col(source_col).alias("s"))))).alias("_s"),
    )
    all_notes = notes.select(id_col).distinct().join(counted, id_col, "left").fillna(0, ["segments", "corrected", "to_check"])
    warnings = F.array_compact(
        F.array(
            F.when(F.col("to_check") > 0, F.lit("NOTEBOOK_SEGMENTS_TO_CHECK")),
            F.when(F.col("corrected") > 0, F.lit("NOTEBOOK_SEGMENTS_CORRECTED")),
            F.when(F.col("segments") == 0, F.lit("NOTEBOOK_EMPTY_TRANSCRIPTION")),
        )
    )
    sources = F.array_distinct(F.transform(F.coalesce("_s", F.array()), lambda x: x["s"]))
    return all_notes.withColumn("warnings", warnings).withColumn("sources", sources).drop("_s")
