"""Files and payloads in: type by content, coded rejection, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by extension.
TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
    "md": "text/markdown",
}
GENERIC = "application/octet-stream"
#: Largest payload in bytes.
LIMIT = 25 * 1024 * 1024


def _files(spark: SparkSession, folder: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(*(F.when(ext == e, F.lit(t)) for e, t in TYPES.items()), F.lit(GENERIC))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).withColumn("media_type", kind)


def read_files(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """(path, media_type, content) of all files below a folder up to ``limit`` bytes; the type is that of the extension.

    The limit is a filter on the file's length that the source takes, so larger files are not loaded.
    """
    return _files(spark, folder).filter(F.col("length") <= limit).select("path", "media_type", "content")


def oversized_files(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """(path, media_type, length, code) of files over ``limit`` bytes, of which only the listing is read."""
    return _files(spark, folder).filter(F.col("length") > limit).select("path", "media_type", "length", F.lit("DOCUMENT_TOO_LARGE").alias("code"))


def sniff_media_type(df: DataFrame) -> DataFrame:
    """The type that the first bytes show beats the declared one; ``warnings`` tell of the difference."""
    head = F.hex(F.substring("content", 1, 8))
    trimmed = F.regexp_replace(head, "^(?:20|09|0A|0D)+", "")
    seen = F.when(trimmed.startswith("25504446"), TYPES["pdf"]).when(head.startswith("504B0304"), TYPES["docx"])
    legacy = head.startswith("D0CF11E0")
    differs = seen.isNotNull() & (seen != F.col("media_type"))
    warnings = F.array_compact(F.array(F.when(legacy, F.lit("LEGACY_DOC_FORMAT")), F.when(differs, F.lit("MEDIA_TYPE_MISMATCH"))))
    return df.withColumn("warnings", F.coalesce(warnings, F.array().cast("array<string>"))).withColumn("media_type", F.coalesce(seen, F.col("media_type")))


def gate_payloads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with binary content, rejected rows with ``code``) of base64 payloads.

    A payload that even without line ends is too long for the limit is not decoded.
    """
    held = F.length(F.regexp_replace("payload", "[\\r\\n]", ""))
    longest = (LIMIT + 2) // 3 * 4 + 4
    raw = F.when((F.length("payload") <= longest) | (held <= longest), F.expr("try_to_binary(payload, 'base64')"))
    decoded = sniff_media_type(df.withColumn("content", raw))
    code = (
        F.when((F.length("payload") > longest) & (held > longest), "DOCUMENT_TOO_LARGE")
        .when(F.col("content").isNull(), "INVALID_BASE64")
        .when(F.octet_length("content") == 0, "EMPTY_DOCUMENT")
        .when(F.octet_length("content") > LIMIT, "DOCUMENT_TOO_LARGE")
        .when(F.array_contains("warnings", "LEGACY_DOC_FORMAT"), "LEGACY_DOC_FORMAT")
        .when(F.col("media_type") == GENERIC, "UNSUPPORTED_MEDIA_TYPE")
    )
    coded = decoded.withColumn("code", code)
    return coded.filter("code is null").drop("code", "payload"), coded.filter("code is not null").drop("content", "payload")


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8; bad bytes become U+FFFD, a byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")
