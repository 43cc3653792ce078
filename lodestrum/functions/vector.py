"""Vector arithmetic on arrays of doubles, summed from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def blend(base: Column, other: Column, weight: float) -> Column:
    return unit(F.zip_with(base, other, lambda x, y: x + weight * y))


def rounded(a: Column, digits: int = 6) -> Column:
    """Each element rounded; what is rounded to nothing keeps its sign, as elsewhere."""
    return F.transform(a, lambda x: F.abs(F.round(x, digits)) * F.signum(x))
