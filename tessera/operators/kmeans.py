"""K-Means over sharded points under every sync mode.

A shard is a value of a grouping column, so a shard may be larger than any machine.  Each step is one aggregation over
all shards; the centres of a step enter it as literals (one global model) or through a broadcast row per shard
(shards x clusters x dimensions numbers, all parameters), and only sums of that size come back.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import sync_modes
from tessera.operators.assignment import align
from tessera.operators.models import by_shard, model_table
from tessera.operators.ring import neighbours


def distances(features: Sequence[str], centres: Sequence[Sequence]) -> list[Column]:
    """Squared distances to each centre, whose coordinates are numbers or columns."""
    out = []
    for centre in centres:
        d = None
        for f, c in zip(features, centre, strict=True):
            diff = F.col(f) - (c if isinstance(c, Column) else F.lit(float(c)))
            d = diff * diff if d is None else d + diff * diff
        out.append(d)
    return out


def nearest(columns: list[str]) -> Column:
    """Index of the least of the distance columns; the lowest index wins ties."""
    best = F.least(*columns) if len(columns) > 1 else F.col(columns[0])
    out = F.lit(len(columns) - 1)
    for k in reversed(range(len(columns) - 1)):
        out = F.when(F.col(columns[k]) == best, k).otherwise(out)
    return out


def assign(points: DataFrame, features: Sequence[str], centres) -> DataFrame:
    """Adds ``cluster`` and ``d2``, the squared distance to its centre."""
    names = [f"__d{k}" for k in range(len(centres))]
    out = points.select("*", *(d.alias(n) for d, n in zip(distances(features, centres), names, strict=True)))
    best = F.least(*names) if len(names) > 1 else F.col(names[0])
    return out.withColumn("cluster", nearest(names)).withColumn("d2", best).drop(*names)


def cluster_stats(points: DataFrame, features: Sequence[str], centres, *by: str) -> DataFrame:
    """``n``, sums of features and ``wcss`` of each cluster with points."""
    return assign(points, features, centres).groupBy(*by, "cluster").agg(
        F.count("*").alias("n"), *(F.sum(f).alias(f"sum_{f}") for f in features), F.sum("d2").alias("wcss")
    )


@dataclass
class Stats:
    """Of one shard: sums (k x d), counts and the within-cluster sum of squares."""

    sums: np.ndarray
    counts: np.ndarray
    wcss: float

    @property
    def rows(self) -> int:
        return int(self.counts.sum())


def _collect(rows, features, k: int, key: Callable) -> dict[int, Stats]:
    out: dict[int, Stats] = {}
    for r in rows:
        s = out.setdefault(key(r), Stats(np.zeros((k, len(features))), np.zeros(k), 0.0))
        s.sums[r["cluster"]] = [r[f"sum_{f}"] for f in features]
        s.counts[r["cluster"]] = r["n"]
        s.wcss += r["wcss"]
    return out


def global_stats(points: DataFrame, features: Sequence[str], centres: np.ndarray) -> Stats:
    """All points as one shard: with centres as columns, code is compiled once for all steps."""
    return shard_stats(points.withColumn("__all", F.lit(0).cast("bigint")), features, {0: np.asarray(centres, float)}, "__all")[0]


def shard_stats(points: DataFrame, features: Sequence[str], models: dict[int, np.ndarray], shard: str = "shard") -> dict[int, Stats]:
    """Each shard's points against its own centres, all shards in one aggregation."""
    k, d = next(iter(models.values())).shape
    names = [[f"__c{i}_{j}" for j in range(d)] for i in range(k)]
    table = model_table(points.sparkSession, shard, {s: m.ravel() for s, m in models.items()}, [n for row in names for n in row])
    joined = points.withColumn(shard, F.col(shard).cast("bigint")).join(table, shard)
    stats = cluster_stats(joined, features, [[F.col(n) for n in row] for row in names], shard)
    found = _collect(stats.collect(), features, k, lambda r: r[shard])
    return {s: found.get(s, Stats(np.zeros((k, d)), np.zeros(k), 0.0)) for s in models}


def moved(centres: np.ndarray, stats: Stats) -> np.ndarray:
    """Means of the clusters; an empty one keeps its place."""
    full = stats.counts > 0
    out = centres.copy()
    out[full] = stats.sums[full] / stats.counts[full, None]
    return out


def shift(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.linalg.norm(a - b))


def weighted(states: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Mean weighted by rows; a plain one if there are none."""
    total = sum(n for _, n in states)
    return sum(m * (n / total if total > 0 else 1 / len(states)) for m, n in states)


def initial_centres(points: DataFrame, features: Sequence[str], k: int, seed: int = 42, order: str | None = None) -> np.ndarray:
    """k-means++ on a bounded sample of max(10 k, 200) rows, those with the smallest hashes."""
    sample = points.select(*features).dropna().orderBy(F.xxhash64(*([order] if order else features), F.lit(seed))).limit(max(10 * k, 200))
    x = np.array([list(r) for r in sample.collect()], float)
    if not len(x):
        raise ValueError("no points to seed centres from")
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    while len(out) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in out], axis=0)
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(out)


@dataclass
class Result:
    centres: np.ndarray
    wcss: float
    rows: int
    rounds: int
    converged: bool
    shards: dict[int, np.ndarray] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)


def _local(points, features, models, epochs, shard) -> tuple[dict[int, np.ndarray], dict[int, Stats]]:
    """``epochs`` Lloyd steps in every shard; statistics of the models that went in last."""
    if epochs < 1:
        raise ValueError("at least one local epoch")
    for _ in range(epochs):
        stats = shard_stats(points, features, models, shard)
        models = {s: moved(m, stats[s]) for s, m in models.items()}
    return models, stats


def merge_aligned(models: dict[int, np.ndarray], rows: dict[int, float], reference: np.ndarray | None = None) -> np.ndarray:
    first = models[min(models)] if reference is None else reference
    return weighted([(align(first, models[s]), rows[s]) for s in sorted(models)])


def fit(
    points: DataFrame, features: Sequence[str], centres: np.ndarray, mode: str | None = None, *, shard: str = "shard", rounds: int = 20, local_epochs: int = 5,
    tol: float = 1e-4, fanout: int | None = None, rate: float = 0.5, damping: bool = True, arrivals: Sequence[int] | None = None, legacy_shift: bool = False, reseed: bool = False, seed: int = 42,
) -> Result:
    """K-Means under a sync mode.  ``wcss`` is that of the returned centres over all points.

    ``arrivals`` orders the updates of ``ps_async`` (shards, in turn; by default round robin).  Points should be cached by
    the caller.  Empty clusters keep their place; with ``reseed`` the exact mode moves them to seeded points.
    """
    mode = sync_modes.normalise(mode)
    centres = np.asarray(centres, float)
    if mode == sync_modes.ALLREDUCE:
        return _allreduce(points, features, centres, rounds, tol, legacy_shift, reseed, seed)
    shards = sorted(r[0] for r in points.select(F.col(shard).cast("bigint")).distinct().collect())
    if not shards:
        raise ValueError("no points")
    models, log, converged, used = {s: centres.copy() for s in shards}, [], False, 0
    rows: dict[int, float] = {}
    if mode == sync_modes.ASYNC:
        base = {s: 0 for s in shards}
        served, version = centres.copy(), 0
        turns = list(arrivals) if arrivals is not None else [s for _ in range(rounds) for s in shards]
        held = by_shard(points, shard, list(features))
        for s in turns:
            part = held.where(F.col(shard) == s)
            out, stats = _local(part, features, {s: models[s]}, local_epochs, shard)
            served, alpha, stale = blend_on_arrival(served, out[s], version, base[s], rate, damping)
            version += 1
            base[s], models[s], rows[s] = version, served.copy(), stats[s].rows
            log.append({"version": version, "shard": s, "staleness": stale, "alpha": alpha})
        held.unpersist()
        final, used = served, len(turns)
    else:
        for used in range(1, rounds + 1):
            local, stats = _local(points, features, models, local_epochs, shard)
            rows = {s: stats[s].rows for s in shards}
            old = models
            if mode == sync_modes.NONE:
                models = local
            elif mode == sync_modes.GOSSIP:
                models = {s: weighted([(local[s], rows[s]), *((align(local[s], local[p]), rows[p]) for p in ring_peers(shards, s, fanout))]) for s in shards}
            elif mode == sync_modes.HYBRID:
                models = dict.fromkeys(shards, weighted([(local[s], rows[s]) for s in shards]))
            else:
                models = dict.fromkeys(shards, merge_aligned(local, rows))
            moved_by = max(shift(old[s], models[s]) for s in shards)
            # The hybrid mode's scalar channel carries the exact sum over all points at the centres just shared.
            scalar = {"scalar": global_stats(points, features, models[shards[0]]).wcss} if mode == sync_modes.HYBRID else {}
            log.append(scalar | {"round": used, "shift": moved_by, "local_wcss": sum(s.wcss for s in stats.values())})
            if mode in (sync_modes.FEDAVG, sync_modes.QUEUE) and moved_by < tol:
                converged = True
                break
        final = merge_aligned(models, rows) if mode in (sync_modes.NONE, sync_modes.GOSSIP) else models[shards[0]]
    whole = global_stats(points, features, final)
    return Result(final, whole.wcss, whole.rows, used, converged, models, log)


def blend_on_arrival(served, new, version: int, base: int, rate: float = 0.5, damping: bool = True):
    """The first update is taken whole; later ones with weight rate / (1 + staleness)."""
    stale = max(0, version - base)
    alpha = 1.0 if version == 0 else rate / (1 + stale) if damping else rate
    return (1 - alpha) * served + alpha * new, alpha, stale


def ring_peers(shards: list[int], s: int, fanout: int | None) -> list[int]:
    at = shards.index(s)
    return [shards[p] for p in neighbours(at, len(shards), fanout)]


def _allreduce(points, features, centres, rounds, tol, legacy_shift, reseed, seed) -> Result:
    log, converged, before, used = [], False, np.zeros_like(centres), 0
    rng = np.random.default_rng(seed)
    for used in range(1, rounds + 1):
        stats = global_stats(points, features, centres)
        new = moved(centres, stats)
        if reseed and (stats.counts < 0.5).any():
            spare = points.select(*features).orderBy(F.xxhash64(*features, F.lit(int(rng.integers(1 << 31))))).limit(len(centres)).collect()
            for i, k in enumerate(np.flatnonzero(stats.counts < 0.5)):
                new[k] = list(spare[i % len(spare)])
        change = shift(before if legacy_shift else centres, new)
        before, centres = centres, new
        log.append({"round": used, "shift": change, "wcss": stats.wcss})
        if used > 1 and change < tol:
            converged = True
            break
    whole = global_stats(points, features, centres)
    return Result(centres, whole.wcss, whole.rows, used, converged, {}, log)


def reassign(points: DataFrame, features: Sequence[str], centres: np.ndarray) -> tuple[np.ndarray, float]:
    """One exact pass over all shards from merged centres."""
    stats = global_stats(points, features, np.asarray(centres, float))
    return moved(np.asarray(centres, float), stats), stats.wcss


def gossip_merge(
    states: dict[int, tuple[np.ndarray, float, int]], *, threshold: float = 1e-3, max_rounds: int = 10, fanout: int = 2, seed: int = 42, reference: np.ndarray | None = None
) -> dict:
    """Adaptive gossip over finished shard models (centres, wcss, rows), a few k x d arrays.

    Each round visits shards in a shuffled order; a shard takes in ``fanout`` peers one after another, its weight
    growing with theirs.  The fan-out shrinks while drift falls fast and grows while it does not.
    """
    if not states:
        raise ValueError("no states")
    rng = random.Random(seed)
    now = {s: np.array(c, float) for s, (c, _, _) in states.items()}
    mass = {s: float(n) for s, (_, _, n) in states.items()}
    fanout = max(1, min(fanout, len(states) - 1))
    log, last, converged = [], None, False
    for r in range(1, max_rounds + 1):
        old = {s: c.copy() for s, c in now.items()}
        order = list(now)
        rng.shuffle(order)
        for s in order:
            others = [o for o in order if o != s]
            for peer in rng.sample(others, min(fanout, len(others))):
                now[s] = weighted([(now[s], mass[s]), (align(now[s], now[peer]), mass[peer])])
                mass[s] += mass[peer]
        # Both sides are matched to the first shard's centres before the round.
        first = old[next(iter(old))]
        drift = max(float(np.linalg.norm(align(first, now[s]) - align(first, old[s]), axis=1).max()) for s in now)
        log.append({"round": r, "fanout": fanout, "max_drift": drift})
        if drift < threshold:
            converged = True
            break
        if last:
            change = drift / last
            fanout = max(1, fanout - 1) if change < 0.5 else min(len(states) - 1, fanout + 1) if change > 0.9 else fanout
        last = drift
    final = merge_aligned(now, {s: n for s, (_, _, n) in states.items()}, reference)
    return {"centres": final, "total_wcss": sum(w for _, w, _ in states.values()), "total_rows": sum(n for *_, n in states.values()), "rounds": len(log), "converged": converged, "log": log}


def mllib_baseline(points: DataFrame, features: Sequence[str], k: int, *, max_iter: int = 20, seed: int = 42, anchors: np.ndarray | None = None, fraction: float | None = None):
    """MLlib's own K-Means (k-means||), on a sample if ``fraction`` is given; ``anchors`` are added as points and steer the start."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    part = points.select(*features).dropna()
    if fraction is not None:
        part = part.sample(fraction, seed=seed)
    if anchors is not None:
        part = points.sparkSession.createDataFrame([[float(x) for x in a] for a in anchors], ", ".join(f"`{f}` double" for f in features)).unionByName(part)
    model = KMeans(k=k, maxIter=max_iter, seed=seed, initSteps=1 if anchors is not None else 2).fit(VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(part))
    return np.array(model.clusterCenters()), model.summary.trainingCost
