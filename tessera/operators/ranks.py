"""Values at given ranks of groups of any size: no group is gathered in an array or sorted by one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], ranges: int = RANGES) -> DataFrame:
    """``by``, ``n`` and, for each name in ``ranks``, the value at the rank (from 0) that its function gives for ``n``.

    Values are cut into ranges by quantiles over all rows; counts by group and range tell in which range a rank lies,
    and only that range's rows are numbered.  Null values are left out, and groups without others give no row.  Equal
    values need no rule.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    cuts = rows.agg(F.percentile_approx("__v", [k / ranges for k in range(1, ranges)], 10000)).first()[0] or []
    # A foldable array: one look per cut at most, no row moves.
    places = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    rows = rows.withColumn("__range", F.size(F.filter(places, lambda c: c < F.col("__v"))))
    counts = rows.groupBy(*by, "__range").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("n", F.sum("__c").over(w)).withColumn("__before", F.sum("__c").over(w.orderBy("__range")) - F.col("__c"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("bigint").alias("rank")) for name, f in ranks.items()])
    counts = counts.withColumn("__a", F.explode(asked)).where((F.col("__a.rank") >= F.col("__before")) & (F.col("__a.rank") < F.col("__before") + F.col("__c")))
    wanted = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__range").alias("__at"), "n", F.col("__a.name").alias("__name"), (F.col("__a.rank") - F.col("__before")).alias("__offset"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)], F.col("__range") == F.col("__at"))
    inside = rows.join(wanted, same).withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__name", "__range").orderBy("__v")) - 1)
    hit = inside.where(F.col("__i") == F.col("__offset"))
    return hit.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks])


def nearest(q: float) -> Callable[[Column], Column]:
    """The rank round-half-even(q / 100 * (n - 1))."""
    return lambda n: F.bround(F.lit(q / 100.0) * (n - 1), 0)


LOWER_QUARTILE = lambda n: F.floor((n - 1) * 0.25)
UPPER_QUARTILE = nearest(75)


def medians(df: DataFrame, by: Sequence[str], value: str, out: str, **more: Callable[[Column], Column]) -> DataFrame:
    """``by``, ``n``, the median (the mean of the two middle values) and further ranks."""
    got = at_ranks(df, by, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.ceil((n - 1) / 2), **more})
    return got.withColumn(out, (F.col("__low") + F.col("__high")) / 2).drop("__low", "__high")
