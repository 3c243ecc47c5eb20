"""Scalar helpers of metric tables and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, default: float | None = 0.0) -> Column:
    v = c.try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(default))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b where b is positive, else ``default``."""
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def memory_mb(c: Column) -> Column:
    """Whole megabytes of texts such as 512m, 4g, 2048k or a bare number of bytes; other texts raise an error."""
    t = F.lower(F.trim(c))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([kmg]?)b?$", 1)
    unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([kmg]?)b?$", 2)
    mb = n.try_cast("double") * F.when(unit == "g", 1024.0).when(unit == "m", 1.0).when(unit == "k", 1.0 / 1024).otherwise(1.0 / (1024 * 1024))
    return F.when(mb.isNull(), F.raise_error(F.concat(F.lit("not a memory size: "), c)).cast("bigint")).otherwise(F.floor(mb))


def bottleneck(fraction: Column, high: float = 0.6, low: float = 0.4) -> Column:
    return F.when(fraction > high, "compute").when(fraction < low, "sync").otherwise("balanced")


def nearest_rank(values: Column, q: float) -> Column:
    """The value of a collected group at round-half-even(q / 100 * (n - 1)), null for an empty one."""
    return F.get(F.sort_array(values), F.bround(F.lit(q / 100.0) * (F.size(values) - 1), 0).cast("int"))


def recommended_memory(p95: Column, peak: Column, step: int = 64) -> Column:
    return (F.ceil(F.greatest(p95 * 1.25, peak * 1.10) / step) * step).cast("bigint")


def verdict(delta: Column, tolerance: float | Column) -> Column:
    return F.when(delta <= tolerance, "PASS").otherwise("FAIL")
