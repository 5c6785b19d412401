"""Array expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str, b: str) -> Column:
    """Cosine of two double arrays; 0 if a side is null or has no length."""
    scale = norm(a) * norm(b)
    return F.coalesce(F.when(scale > 0, dot(a, b) / scale), F.lit(0.0))


def quantile(sorted_values: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) * p of a sorted array; null when it's empty."""
    at = (F.size(sorted_values) - 1) * F.lit(p)
    low, high = F.floor(at), F.ceil(at)
    item = lambda i: F.get(sorted_values, i.cast("int"))
    return item(low) + (item(high) - item(low)) * (at - low)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
