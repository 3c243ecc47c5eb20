"""Relational operators over run metrics: lags, halves, knees, medians, matches."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import bottleneck
from tessera.operators import ranks


def drop_rate(df: DataFrame, value: str, by: list[str], order: str, out: str = "drop_rate") -> DataFrame:
    """(previous - value) / previous; 0 for the first row of a group and after a value that is not positive."""
    prev = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn(out, F.when(prev > 0, (prev - F.col(value)) / prev).otherwise(F.lit(0.0)))


def decay(df: DataFrame, value: str, by: list[str], order: str, out: str = "decay") -> DataFrame:
    """value / first value of the group, a first value of 0 counting as 1."""
    first = F.first_value(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn(out, F.col(value) / F.when(first == 0, F.lit(1.0)).otherwise(first))


def half_averages(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Averages of the first floor(n / 2) rows and of the rest."""
    w = Window.partitionBy(*by)
    at = df.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__h", F.floor(F.count("*").over(w) / 2))
    return at.groupBy(*by).agg(F.avg(F.when(F.col("__i") <= F.col("__h"), F.col(value))).alias("first_half"), F.avg(F.when(F.col("__i") > F.col("__h"), F.col(value))).alias("second_half"))


def cumulative(df: DataFrame, value: str, by: list[str], order: str, out: str = "elapsed") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def following(df: DataFrame, value: str, by: list[str], order: str, out: str) -> DataFrame:
    """The next row's value; the last row of a group goes."""
    return df.withColumn(out, F.lead(value).over(Window.partitionBy(*by).orderBy(order))).where(F.col(out).isNotNull())


def transfer_and_wait(df: DataFrame, sync: str, by: list[str]) -> DataFrame:
    """``transfer``, the least sync time of a round over workers, and ``wait``, what each worker spent beyond it."""
    least = F.min(sync).over(Window.partitionBy(*by))
    return df.withColumn("transfer", least).withColumn("wait", F.col(sync) - least)


def time_to_target(df: DataFrame, loss: str, elapsed: str, target: Column | float, by: list[str]) -> DataFrame:
    """The least elapsed time at which the loss is at most the target; null if it never is."""
    return df.groupBy(*by).agg(F.min(F.when(F.col(loss) <= target, F.col(elapsed))).alias("ttt"))


def contiguous(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Whether a group's numbers are 1 to n."""
    at = df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return at.groupBy(*by).agg(F.bool_and(F.col(order) == F.col("__i")).alias("contiguous"), F.count("*").alias("n"))


def knee(df: DataFrame, value: str, size: str, by: list[str], tolerance: float) -> DataFrame:
    """The smallest size whose value is within the tolerance of the group's best."""
    best = F.min(value).over(Window.partitionBy(*by))
    near = df.withColumn("__best", best).where(F.col(value) <= F.col("__best") * (1 + tolerance))
    return near.groupBy(*by).agg(F.min(size).alias("knee"), F.min_by(value, size).alias("at_knee"))


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted by rows; plain if all weights are 0; 0 without rows.  Null and NaN values are left out."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    v, w = F.when(ok, F.col(value)), F.when(ok, F.col(weight))
    return F.coalesce(F.try_divide(F.sum(v * w), F.sum(w)), F.avg(v), F.lit(0.0))


def variation(df: DataFrame, value: str, by: list[str], least: int = 3) -> DataFrame:
    """Coefficient of variation of groups with ``least`` rows or more."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.stddev_samp(value) / F.avg(value)).alias("cv")).where(F.col("n") >= least)


def first_rows(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__i = 1").drop("__i")


def remaining(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a grid that no finished run covers."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def tolerance_lookup(labels: DataFrame, tolerance: float, column: str = "tol") -> DataFrame:
    return labels.where(F.abs(F.col(column) - tolerance) < 1e-9)


def rebuilt_trace(df: DataFrame, by: list[str], order: str, wall: str) -> DataFrame:
    """Times of samples that have none: 1 + i (wall - 1) / n, i from 0."""
    w = Window.partitionBy(*by)
    return df.withColumn("t_s", 1 + (F.row_number().over(w.orderBy(order)) - 1) * (F.col(wall) - 1) / F.count("*").over(w))


def maximin_design(points: list[tuple[float, ...]], size: int, cap: dict[int, int] | None = None, start: int = 0) -> list[int]:
    """Indices of a greedy farthest-point design over a few hundred cells, from cell ``start``.

    ``cap`` bounds how often a level of a factor is used; ties (to nine places) go to the first cell.
    """
    if not points or size < 1:
        return []
    chosen = [start]
    used = {(f, v): 1 for f, v in enumerate(points[start])}
    near = [round(sum((a - b) ** 2 for a, b in zip(p, points[start], strict=True)), 9) for p in points]
    while len(chosen) < min(size, len(points)):
        free = [i for i, p in enumerate(points) if i not in chosen and all(used.get((f, p[f]), 0) < n for f, n in (cap or {}).items())]
        if not free:
            break
        best = max(free, key=lambda i: (near[i], -i))
        chosen.append(best)
        for f, v in enumerate(points[best]):
            used[f, v] = used.get((f, v), 0) + 1
        near = [min(d, round(sum((a - b) ** 2 for a, b in zip(p, points[best], strict=True)), 9)) for p, d in zip(points, near, strict=True)]
    return chosen


@dataclass(frozen=True)
class Design:
    """Cells in the order in which they are run; where the choice began, and each run's place in it."""

    cells: list[tuple]
    start: int
    order: list[int]


def seeded_design(levels: dict[str, tuple], size: int, seed: int) -> Design:
    """A farthest-point design over the full grid of ``levels``, each scaled to 0..1 by its place.

    It begins at a random cell, uses a level at most ceil(size / levels) + 1 times, and is run in a random order.
    """
    rng = np.random.default_rng(seed)
    values = list(levels.values())
    grid = list(itertools.product(*[range(len(v)) for v in values]))
    size = min(size, len(grid))
    unit = [tuple(k / max(1, len(v) - 1) for k, v in zip(g, values, strict=True)) for g in grid]
    start = int(rng.integers(len(grid)))
    chosen = maximin_design(unit, size, {f: -(-size // len(v)) + 1 for f, v in enumerate(values)}, start)
    order = [int(i) for i in rng.permutation(len(chosen))]
    return Design([tuple(v[k] for k, v in zip(grid[chosen[i]], values, strict=True)) for i in order], start, order)


def seeded_order(runs: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``position`` (from 1): runs in the order of md5("seed:key"), a frame of a design's size."""
    return runs.withColumn("position", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)).cast("bigint"))


def epoch_detail(df: DataFrame) -> DataFrame:
    """Shares, losses and gradients of each run's epochs as its worker 0 met them, and how far workers' times lay apart."""
    w = Window.partitionBy("run").orderBy("iteration")
    first, before = F.first("grad_norm").over(w), F.lag("loss").over(w)
    share = lambda part, scale: F.round(F.when(F.col("iter_time_s") > 0, F.col(part) / F.col("iter_time_s") * scale).otherwise(0.0), 4)
    ref = df.where("worker = 0").withColumns({
        "sync_pct": share("sync_time_s", 100), "fraction": share("spark_time_s", 1), "loss_drop_rate": F.round(F.when(before > 0, (before - F.col("loss")) / before).otherwise(0.0), 6),
        "grad_norm_decay": F.round(F.col("grad_norm") / F.when(first > 0, first).otherwise(1.0), 6),
    })
    apart = df.groupBy("run", "iteration").agg(F.round(F.when(F.count("*") > 1, F.max("iter_time_s") - F.min("iter_time_s")).otherwise(0.0), 6).alias("rank_variance_s"))
    return ref.withColumn("bottleneck", bottleneck(F.col("fraction"))).join(apart, ["run", "iteration"])


def ttt_speedup(keys: DataFrame, runs: DataFrame, base: DataFrame, by: list[str], value: str) -> DataFrame:
    """Medians of the times to a target of runs and of a baseline, how many got there, and the ratio of the medians."""
    a = ranks.medians(runs, by, value, "median_ttt_s").withColumnRenamed("n", "reached")
    b = ranks.medians(base, by, value, "base_median_ttt_s").withColumnRenamed("n", "base_reached")
    out = keys.join(a, by, "left").join(b, by, "left").fillna(0, ["reached", "base_reached"])
    return out.withColumn("speedup", F.try_divide("base_median_ttt_s", "median_ttt_s"))
