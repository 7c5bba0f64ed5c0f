"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def decode(text: Column) -> Column:
    """'[1,2,...]' as array<double>."""
    return F.from_json(text, "array<double>")


def rrf_score(ranks: Column, k: int) -> Column:
    """Sum of 1 / (k + rank); 0 for no ranks."""
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + F.lit(1.0) / (r + F.lit(k)))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at place round(fraction * (n - 1)), halves to even, of the values in order; 0.0 of none. values: an array."""
    n = F.size(values)
    at = F.bround(F.lit(float(fraction)) * (n - 1)).cast("int")
    return F.coalesce(F.get(F.array_sort(values), F.least(F.greatest(at, F.lit(0)), n - 1)), F.lit(0.0))
