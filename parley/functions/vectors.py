"""Vector expressions over ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """L2 distance; infinite when either side is missing."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.coalesce(F.sqrt(_total(squares)), F.lit(float("inf")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x)))


def mean(a: Column) -> Column:
    return F.try_divide(_total(F.transform(a, lambda x: x.cast("double"))), F.size(a))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def standardised(a: Column) -> Column:
    """(x - mean) / (population standard deviation + 1e-5), element by element."""
    spread = lambda mu: F.sqrt(F.try_divide(_total(F.transform(a, lambda x: (x - mu) * (x - mu))), F.size(a)))
    scaled = lambda mu: bind(spread(mu) + F.lit(1e-5), lambda sd: F.transform(a, lambda x: (x - mu) / sd))
    return bind(mean(a), scaled)
