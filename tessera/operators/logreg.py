"""Logistic regression over sharded points under every sync mode.

As in K-Means a shard is a value of a column.  One aggregation gives the loss and gradient of every shard at its own
weights; shards' solvers run in step on the driver, which holds only a few numbers for each.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.linalg import linear, log_one_plus_exp, sigmoid
from tessera.operators import sync_modes
from tessera.operators.kmeans import blend_on_arrival, ring_peers, weighted
from tessera.operators.lbfgs import Trace, minimise
from tessera.operators.models import by_shard, model_table


def loss_terms(features: Sequence[str], label: str, weights: Sequence, intercept) -> tuple[Column, list[Column], Column]:
    """Per point: loss, its derivatives by weights and intercept, and whether the prediction is right (z >= 0 for label >= 0.5)."""
    z = linear([F.col(f) for f in features], [w if isinstance(w, Column) else float(w) for w in weights], intercept if isinstance(intercept, Column) else float(intercept))
    y = F.col(label).cast("double")
    residual = sigmoid(z) - y
    return log_one_plus_exp(z) - y * z, [residual * F.col(f) for f in features] + [residual], (z >= 0) == (y >= 0.5)


def point_stats(points: DataFrame, features: Sequence[str], label: str, weights, intercept, *by: str) -> DataFrame:
    loss, grads, right = loss_terms(features, label, weights, intercept)
    sums = [F.sum(g).alias(f"g{i}") for i, g in enumerate(grads)]
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), F.count_if(right).alias("correct"), *sums)


@dataclass
class Stats:
    """Means over a shard's rows."""

    n: int
    loss: float
    gradient: np.ndarray
    correct: int


def _stats(r, d: int) -> Stats:
    n = r["n"]
    return Stats(n, r["loss"] / n if n else 0.0, np.array([r[f"g{i}"] / n if n else 0.0 for i in range(d + 1)]), r["correct"])


def shard_stats(points: DataFrame, features: Sequence[str], label: str, models: dict[int, np.ndarray], shard: str = "shard") -> dict[int, Stats]:
    """Statistics of each shard at its own model (weights, then intercept), in one aggregation."""
    d = len(features)
    names = [f"__w{i}" for i in range(d + 1)]
    table = model_table(points.sparkSession, shard, models, names)
    joined = points.withColumn(shard, F.col(shard).cast("bigint")).join(table, shard)
    cols = [F.col(n) for n in names]
    rows = point_stats(joined, features, label, cols[:d], cols[d], shard).collect()
    found = {r[shard]: _stats(r, d) for r in rows}
    return {s: found.get(s, Stats(0, 0.0, np.zeros(d + 1), 0)) for s in models}


def regularised(stats: Stats, model: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Adds reg / 2 |w|^2; the intercept is free."""
    pull = np.append(model[:-1], 0.0) * reg
    return stats.loss + 0.5 * reg * float(model[:-1] @ model[:-1]), stats.gradient + pull


def moments(points: DataFrame, features: Sequence[str], floor: float = 1e-8) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation by sums; a deviation under ``floor`` counts as 1."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.avg(F.col(f) * F.col(f)).alias(f"s_{f}"))]
    r = points.agg(*aggs).first()
    out = {}
    for f in features:
        m = r[f"m_{f}"] or 0.0
        sd = max((r[f"s_{f}"] or 0.0) - m * m, 0.0) ** 0.5
        out[f] = (m, sd if sd >= floor else 1.0)
    return out


def standardised(points: DataFrame, features: Sequence[str], by: dict[str, tuple[float, float]]) -> DataFrame:
    return points.withColumns({f: (F.col(f) - by[f][0]) / by[f][1] for f in features})


def deviations(points: DataFrame, features: Sequence[str], shard: str) -> dict[int, np.ndarray]:
    """Sample standard deviations of each shard's features; one that is 0 or missing counts as 1."""
    rows = points.groupBy(F.col(shard).cast("bigint").alias("__s")).agg(*(F.stddev_samp(f).alias(f"d{i}") for i, f in enumerate(features))).collect()
    return {r["__s"]: np.array([r[f"d{i}"] or 1.0 for i in range(len(features))] + [1.0]) for r in rows}


def local_solve(points, features, label, models, reg, steps, shard, solver: str, rate: float, scales: dict[int, np.ndarray] | None = None) -> tuple[dict[int, np.ndarray], dict[int, Stats], dict[int, Trace]]:
    """Every shard's solver in step, warm-started: ``lbfgs`` with at most ``steps`` iterations, or ``gd`` steps.

    With ``scales`` a shard is solved as if its features were divided by its own: the penalty and the steps are those
    of the scaled problem, and models go in and come out in the features' own units.
    """
    traces = {s: Trace() for s in models}
    unit = np.ones(len(features) + 1)
    by = {s: (scales or {}).get(s, unit) for s in models}
    inner = {s: m * by[s] for s, m in models.items()}

    def ask(at: dict[int, np.ndarray]) -> dict[int, Stats]:
        return shard_stats(points, features, label, {s: u / by[s] for s, u in at.items()}, shard)

    def told(stats: Stats, s: int, u: np.ndarray) -> tuple[float, np.ndarray]:
        return regularised(Stats(stats.n, stats.loss, stats.gradient / by[s], stats.correct), u, reg)

    first = None
    if solver == "gd":
        for _ in range(steps):
            stats = ask(inner)
            first = first or stats
            new = {}
            for s, u in inner.items():
                loss, g = told(stats[s], s, u)
                traces[s].losses.append(loss)
                new[s] = u - rate * g
            inner = new
        return {s: u / by[s] for s, u in inner.items()}, first, traces
    runs = {s: minimise(u, steps, traces[s]) for s, u in inner.items()}
    asked = {s: next(r) for s, r in runs.items()}
    out: dict[int, np.ndarray] = {}
    while asked:
        stats = ask(asked)
        first = first or stats
        following = {}
        for s, x in asked.items():
            try:
                following[s] = runs[s].send(told(stats[s], s, x))
            except StopIteration as e:
                out[s] = e.value / by[s]
        asked = following
    return out, first, traces


@dataclass
class Result:
    weights: np.ndarray
    intercept: float
    loss: float
    accuracy: float
    rows: int
    rounds: int
    converged: bool
    log: list[dict] = field(default_factory=list)
    #: A row for each shard and round: norms of its own and the shared weights, intercept, rows, losses, evaluations.
    workers: list[dict] = field(default_factory=list)
    #: Mean and deviation of each feature where weights are those of standardised features.
    moments: dict[str, tuple[float, float]] | None = None


def converged(now: float, before: float | None, tol: float) -> bool:
    """Relative change of the loss; a tolerance of 0 or less never stops."""
    return tol > 0 and before is not None and abs(now - before) <= tol * max(abs(before), 1e-12)


def fit(
    points: DataFrame, features: Sequence[str], label: str = "label", mode: str | None = None, *, shard: str = "shard", rounds: int = 10, local_steps: int = 5, reg: float = 0.01,
    tol: float = 1e-4, solver: str = "lbfgs", rate: float = 0.5, fanout: int | None = None, server_rate: float = 0.5, damping: bool = True, arrivals: Sequence[int] | None = None,
    warm_start: bool = True, epochs: int = 30, epoch_rate: float = 0.01, freeze_tol: float = 0.0, start: np.ndarray | None = None,
    standardise: bool | None = None,
) -> Result:
    """Logistic regression under a sync mode; loss and accuracy are those of the returned model over all points.

    The exact mode takes ``epochs`` single gradient steps with a cosine rate and no intercept; its gradients are means
    over shards, each shard alike.  Independent shards solve the same problem in every round, so it is solved once.
    Unless ``standardise`` says otherwise, the exact mode takes features less their means by their deviations over all
    points (its weights are those of such features, by ``Result.moments``), the independent and the queue mode solve a
    shard by its own deviations as MLlib does (weights in the features' own units), and the others take features as
    they are.  Points should be cached by the caller.
    """
    mode = sync_modes.normalise(mode)
    if standardise is None:
        standardise = mode in (sync_modes.ALLREDUCE, sync_modes.NONE, sync_modes.QUEUE)
    d = len(features)
    model = np.zeros(d + 1) if start is None else np.asarray(start, float).copy()
    if mode == sync_modes.ALLREDUCE:
        by = moments(points, features) if standardise else None
        whole = standardised(points, features, by) if by else points
        return replace(_allreduce(whole, features, label, shard, model, epochs, epoch_rate, reg, tol), moments=by)
    shards = sorted(r[0] for r in points.select(F.col(shard).cast("bigint")).distinct().collect())
    if not shards:
        raise RuntimeError("no usable rows")
    models, log, stop, before, used, rows = {s: model.copy() for s in shards}, [], False, None, 0, {}
    workers, began = [], time.perf_counter()
    scales = deviations(points, features, shard) if standardise else None
    solve = lambda part, m: local_solve(part, features, label, m, reg, local_steps, shard, solver, rate, scales)
    if mode == sync_modes.ASYNC:
        served, version, base = model.copy(), 0, dict.fromkeys(shards, 0)
        turns = list(arrivals) if arrivals is not None else [s for _ in range(rounds) for s in shards]
        held = by_shard(points, shard, list(features))
        for s in turns:
            out, stats, _ = solve(held.where(F.col(shard) == s), {s: models[s]})
            served, alpha, stale = blend_on_arrival(served, out[s], version, base[s], server_rate, damping)
            version += 1
            workers.append(_worker_round(s, 1 + sum(w["worker_id"] == s for w in workers), out[s], served, models[s], stats[s].n))
            base[s], models[s], rows[s] = version, served.copy(), stats[s].n
            log.append({"version": version, "shard": s, "staleness": stale, "alpha": alpha, "worker_round": workers[-1]["iteration"], "rows": stats[s].n, "weight_norm": workers[-1]["weight_norm"], "elapsed_s": time.perf_counter() - began})
        held.unpersist()
        final, used = served, len(turns)
    else:
        frozen: dict[int, bool] = dict.fromkeys(shards, False)
        for used in range(1, rounds + 1):
            if mode == sync_modes.NONE and used > 1:
                log.append(log[0] | {"round": used, "evaluations": 0})
                workers += [w | {"iteration": used, "weight_delta": 0.0, "n_eval": 0} for w in workers if w["iteration"] == 1]
                continue
            entering = models if warm_start and mode != sync_modes.NONE else {s: model.copy() for s in shards}
            going = {s: m for s, m in entering.items() if not frozen[s]}
            local, stats, traces = solve(points, going) if going else ({}, {}, {})
            local = {s: local.get(s, models[s]) for s in shards}
            rows |= {s: t.n for s, t in stats.items()}
            if mode == sync_modes.NONE:
                models = local
            elif mode == sync_modes.GOSSIP:
                models = {s: weighted([(local[s], rows[s]), *((local[p], rows[p]) for p in ring_peers(shards, s, fanout))]) for s in shards}
                if freeze_tol > 0:
                    frozen = {s: frozen[s] or float(np.linalg.norm(models[s] - entering[s])) < freeze_tol for s in shards}
            else:
                models = dict.fromkeys(shards, weighted([(local[s], rows[s]) for s in shards]))
            total = sum(rows.values())
            workers += [_worker_round(s, used, local[s], models[s], entering[s], rows[s]) | {"loss_start": traces[s].losses[0] if s in traces and traces[s].losses else None, "n_eval": traces[s].evaluations if s in traces else 0} for s in shards]
            loss = sum(regularised(t, entering[s], reg)[0] * t.n for s, t in stats.items()) / max(1, sum(t.n for t in stats.values()))
            scalar = {"scalar": float(models[shards[0]][-1]), "elapsed_s": time.perf_counter() - began} if mode == sync_modes.HYBRID else {}
            log.append(scalar | {"round": used, "global_loss": loss, "rows": total, "evaluations": sum(t.evaluations for t in traces.values())})
            if mode in (sync_modes.FEDAVG, sync_modes.QUEUE) and converged(loss, before, tol):
                stop = True
                break
            before = loss
        final = weighted([(models[s], rows[s]) for s in shards])
    return replace(_finish(points, features, label, final, used, stop, log), workers=workers)


def _worker_round(shard: int, used: int, local: np.ndarray, shared: np.ndarray, entering: np.ndarray, rows: int) -> dict:
    return {
        "worker_id": int(shard), "iteration": used, "weight_norm": float(np.linalg.norm(shared[:-1])), "weight_delta": float(np.linalg.norm(shared[:-1] - entering[:-1])),
        "local_weight_norm": float(np.linalg.norm(local[:-1])), "intercept": float(shared[-1]), "row_count": int(rows),
    }


def _finish(points, features, label, model, used, stop, log) -> Result:
    s = _stats(point_stats(points, features, label, model[:-1], model[-1]).first(), len(features))
    return Result(model[:-1], float(model[-1]), s.loss, s.correct / s.n if s.n else 0.0, s.n, used, stop, log)


def cosine_rate(step: int, steps: int, high: float, low: float = 0.0) -> float:
    return high if steps <= 1 else low + 0.5 * (high - low) * (1 + float(np.cos(np.pi * step / steps)))


def _allreduce(points, features, label, shard, model, epochs, rate, reg, tol) -> Result:
    log, before, stop, used = [], None, False, 0
    model[-1] = 0.0
    shards = [r[0] for r in points.select(F.col(shard).cast("bigint")).distinct().collect()]
    if not shards:
        raise RuntimeError("no usable rows")
    for used in range(1, epochs + 1):
        rows = list(shard_stats(points, features, label, dict.fromkeys(shards, model), shard).values())
        loss = float(np.mean([s.loss for s in rows]))
        step = cosine_rate(used - 1, epochs, rate)
        model[:-1] -= step * (np.mean([s.gradient[:-1] for s in rows], axis=0) + reg * model[:-1])
        log.append({"epoch": used, "global_loss": loss, "rate": step})
        if before is not None and abs(loss - before) < tol:
            stop = True
            break
        before = loss
    return _finish(points, features, label, model, used, stop, log)


def predict(points: DataFrame, features: Sequence[str], weights, intercept, out: str = "prediction") -> DataFrame:
    z = linear([F.col(f) for f in features], [float(w) for w in weights], float(intercept))
    return points.withColumn(out, F.when(sigmoid(z) >= 0.5, 1.0).otherwise(0.0))


def mllib_baseline(points: DataFrame, features: Sequence[str], label: str = "label", *, max_iter: int = 10, reg: float = 0.01, parity_iter: int | None = None):
    """MLlib's own logistic regression (L-BFGS, standardised); ``parity_iter``, if given, stands in for ``max_iter``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(points.select(*features, F.col(label).cast("double").alias("label")).dropna())
    return LogisticRegression(maxIter=parity_iter or max_iter, regParam=reg, standardization=True).fit(data)


def baseline_report(points: DataFrame, features: Sequence[str], label: str = "label", **options) -> dict:
    """The baseline's figures; a fit that fails is reported (``error``) and not raised."""
    try:
        m = mllib_baseline(points, features, label, **options)
    except Exception as e:  # whatever the solver or the reader says is the report
        return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
    return {"error": None, "weights": [float(x) for x in m.coefficients], "intercept": float(m.intercept), "iterations": int(m.summary.totalIterations), "accuracy": float(m.summary.accuracy)}
