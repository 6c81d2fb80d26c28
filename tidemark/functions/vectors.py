"""Vector arithmetic on ARRAY columns in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero for vectors that are null, zero, not finite or of different length."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((n > 0) & (n < float("inf")), dot(a, b) / n), F.lit(0.0))


def valid(a: Column, dim: int) -> Column:
    """Of the dimension, all finite, not all zero; null is not valid."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))


def clamp_confidence(c: Column) -> Column:
    """A number in [0, 1]; null for what is no finite number."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
