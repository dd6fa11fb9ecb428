"""Vector functions over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column | str) -> Column:
    """The vector over its length, which counts as 1e-12 at least."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(col(a), lambda x: x / n)


def finite(a: Column | str) -> Column:
    return ~F.exists(col(a), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def softmax(a: Column | str) -> Column:
    """Softmax probabilities, the largest value taken off first."""
    top = F.array_max(col(a))
    total = F.aggregate(col(a), F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(col(a), lambda x: F.exp(x - top) / total)
