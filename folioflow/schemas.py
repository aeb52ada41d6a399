"""Explicit schemas and closed value sets of the corpus tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(spec: str) -> T.StructType:
    """``name kind[ not null], ...``; needs no session."""
    fields = [f.strip().split(" ", 2) for f in spec.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind], not rest) for name, kind, *rest in fields])


DOCUMENTS = _struct(
    "external_id string, course_id string, role string, title string, source_reference string, country string, "
    "subject string, level string, track string, grade string, curriculum_version string, language string, "
    "embedding_model string, embedding_dimension int, content string, characters int, chunk_count int, indexed_at timestamp"
)
CHUNKS = _struct("chunk_id string, external_id string, ordinal int, locator string, content string, token_count int, embedding array<float>")
NOTEBOOK_DOCUMENTS = _struct(
    "external_id string, student_account_id string not null, title string, country string, subject string, track string, grade string, "
    "curriculum_version string, language string, chapter string, embedding_model string, embedding_dimension int, characters int, "
    "chunk_count int, indexed_at timestamp"
)
NOTEBOOK_CHUNKS = _struct(
    "chunk_id string, external_id string, student_account_id string not null, ordinal int, locator string, content string, token_count int, embedding array<float>"
)
ISSUES = _struct("kind string, start int, end int, excerpt string")

#: Roles a document can have; only the first belongs to a course.
COURSE_ROLES = ("published_course", "teacher_material")
OFFICIAL_ROLES = ("official_curriculum", "past_paper")
ROLES = COURSE_ROLES + OFFICIAL_ROLES


@dataclass(frozen=True)
class Scope:
    """Where a search may look.  Level and track are neutral when empty."""

    country: str
    subject: str
    grade: str
    curriculum_version: str
    language: str
    level: str = ""
    track: str = ""

    def terms(self) -> dict[str, str]:
        """The equalities that filter: the mandatory ones, and level and track unless empty."""
        found = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: v for k, v in found.items() if v != "" or k not in ("level", "track")}
