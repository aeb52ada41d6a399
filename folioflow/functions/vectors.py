"""Vector arithmetic on arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null if a vector is null, NaN if one is zero."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.lit(1.0) - F.when(size > 0, dot(a, b) / size).otherwise(F.lit(float("nan")))


def score(distance: Column) -> Column:
    """1 - distance within 0 and 1, six digits, never a negative zero."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - distance)), 6) + F.lit(0.0)
