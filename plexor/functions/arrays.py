"""Column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmax(a: Column) -> Column:
    """Position from 0 of the first largest element; of an all-zero row, 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def l1_rows(a: Column) -> Column:
    """Divided by the sum; rows that sum to 0 stay."""
    s = total(a)
    return F.when(s > 0, F.transform(a, lambda x: x / s)).otherwise(a)


def l2_rows(a: Column) -> Column:
    """Divided by the Euclidean length; zero rows stay."""
    s = F.sqrt(dot(a, a))
    return F.when(s > 0, F.transform(a, lambda x: x / s)).otherwise(a)


def soft_threshold(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: F.greatest(x - by, F.lit(0.0)))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
