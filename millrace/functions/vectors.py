"""Vector functions on array columns, in double precision, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size < ZERO, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def similarity_class(value: Column) -> Column:
    return F.when(value >= 0.98, "duplicate").when(value >= 0.90, "very_similar").when(value >= 0.80, "similar").otherwise("low")


def is_valid(a: str) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
