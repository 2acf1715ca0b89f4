"""Distances between two vector columns, summed left to right in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARRAY_OF_DOUBLE = "array<double>"


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    x, y = a.cast(ARRAY_OF_DOUBLE), b.cast(ARRAY_OF_DOUBLE)
    return _fold(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)))


def dot(a: Column, b: Column) -> Column:
    x, y = a.cast(ARRAY_OF_DOUBLE), b.cast(ARRAY_OF_DOUBLE)
    return _fold(F.zip_with(x, y, lambda p, q: p * q))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos``; a vector of zeros is at distance 1 from everything."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))
