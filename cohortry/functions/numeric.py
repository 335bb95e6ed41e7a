"""Column expressions over numbers and arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def finite_or_null(x: Column) -> Column:
    """Infinities and NaN as null."""
    d = x.cast("double")
    return F.when(~(F.isnan(d) | (F.abs(d) == float("inf"))), d)


def zscore(x: Column, window=None) -> Column:
    """Over all rows (or a window), with the population's deviation; 0 where that is 0.

    Without a window this needs one: over all rows Spark gathers them in one task. See ``features.standardize``.
    """
    w = window or Window.partitionBy(F.lit(0))
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 1e-12, (x - F.avg(x).over(w)) / sd).otherwise(0.0)


def relative_distance(positive: Column, negative: Column) -> Column:
    """Above 0 where the positive side is nearer."""
    return (negative - positive) / F.greatest(F.abs(negative) + F.abs(positive), F.lit(1e-6))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def softmax(a: Column, temperature: Column | float = 1.0) -> Column:
    """Of an array, shifted by its maximum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / t))
    return F.transform(e, lambda x: x / total(e))


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x / total(a))


def argmax(a: Column) -> Column:
    """Position from 0 of the largest element; the first of equal ones."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def nonzero(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x > 0))


def inverse_distance_confidence(d: Column) -> Column:
    return 1.0 / (1.0 + d)


def exclusive_quantile(values: Column, p: float) -> Column:
    """Of a sorted array, at position p (n + 1) with linear interpolation, ends held."""
    n = F.size(values)
    at = F.lit(p) * (n + 1)
    lo = F.greatest(F.lit(1), F.least(n - 1, F.floor(at).cast("int")))
    a, b = F.element_at(values, lo), F.element_at(values, lo + 1)
    return F.when(n > 1, a + (b - a) * (at - lo)).otherwise(F.element_at(values, 1))
