"""Expressions over arrays of doubles and over stable logistic terms; all run inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    """By differences: the expanded form loses digits to cancellation."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def add_scaled(a: Column, b: Column, scale: Column | float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * scale)


def blend(old: Column, new: Column, alpha: Column | float) -> Column:
    """(1 - alpha) old + alpha new, element by element."""
    return F.zip_with(old, new, lambda x, y: x * (1 - alpha) + y * alpha)


def sigmoid(z: Column) -> Column:
    """exp overflows to infinity, whose reciprocal is 0, so no clipping is needed."""
    return 1 / (1 + F.exp(-z))


def log_one_plus_exp(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(z)))


def linear(features: list[Column], weights: list, intercept) -> Column:
    z = F.lit(intercept) if not isinstance(intercept, Column) else intercept
    for f, w in zip(features, weights, strict=True):
        z = z + f * w
    return z


def cosine_rate(step: Column, steps: int, high: float, low: float = 0.0) -> Column:
    """Cosine decay from ``high`` to ``low``; ``high`` throughout when there is at most one step."""
    if steps <= 1:
        return F.lit(float(high))
    return low + 0.5 * (high - low) * (1 + F.cos(F.pi() * step / steps))


def staleness_rate(staleness: Column, rate: float = 0.5) -> Column:
    return rate / (1 + F.greatest(staleness, F.lit(0)))
