"""Vector and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import config as C


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product clamped to -1 to 1; vectors of different lengths are an error."""
    raw = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    checked = F.when(F.size(a) == F.size(b), raw).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), checked))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """The vector of length 1; a zero vector or one that isn't finite is an error."""
    n = norm(v)
    good = (n > 0) & (n < float("inf")) & ~F.isnan(n)
    return F.when(good, F.transform(as_double(v), lambda x: x / n)).otherwise(F.raise_error(F.lit("vector without a direction")).cast("array<double>"))


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def match_percent(score: Column) -> Column:
    return F.lit(100.0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def is_relevant(score: Column) -> Column:
    """Finite and of the minimum match or more. Spark takes NaN for larger than any number, so it is ruled out first."""
    return F.coalesce(finite(score) & (match_percent(score) >= C.MIN_MATCH_PERCENT), F.lit(False))


def relevance_score(score: Column, evidence: Column) -> Column:
    return F.coalesce(evidence, score)


def is_relevant_result(score: Column, evidence: Column, excluded: Column) -> Column:
    return excluded.isNull() & is_relevant(relevance_score(score, evidence))
