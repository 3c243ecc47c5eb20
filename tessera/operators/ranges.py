"""Ranges of an integer key cut at its quantiles, so that an order over all rows needs no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cuts_of(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most ``ranges`` - 1 ascending keys that cut the rows into about equal parts."""
    if ranges <= 1:
        return []
    return sorted(set(df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10000)).first()[0] or []))


def _array(values: list[int]) -> str:
    """A literal array of longs; it is parsed once."""
    return "cast(split('" + ",".join(map(str, values)) + "', ',') as array<bigint>)"


def range_of(key: str, cuts: list[int]) -> str:
    """SQL for the number of cuts below a key; nulls form a range after all others.

    Cuts are looked at in two levels, so a row meets about twice the square root of their number.
    """
    if not cuts:
        return f"if(`{key}` is null, 1, 0)"
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    padded = [c for g in groups for c in g]
    heads = _array([g[-1] for g in groups])
    inner = f"slice({_array(padded)}, g * {width} + 1, {width})"
    place = f"transform(array(size(filter({heads}, c -> c < `{key}`))), g -> if(g = {len(groups)}, {len(cuts)}, g * {width} + size(filter({inner}, c -> c < `{key}`))))[0]"
    return f"if(`{key}` is null, {len(cuts) + 1}, {place})"


def by_range(values: dict[int, int], ranges: int, index: str) -> str:
    """SQL for a number of each range (0 where it has none)."""
    return f"get({_array([values.get(k, 0) for k in range(ranges)])}, {index})"
