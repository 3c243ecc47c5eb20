"""K-Means and logistic regression, in single steps that SQL can follow and whole under each sync mode."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import recorders
from tessera.operators import assignment, kernels, kmeans, logreg, ring, sync_modes
from tessera.plans.tables import POINT_FEATURES, SCALED, SHARDS, scaled

QUERIES, SQL = {}, {}
# Fixed starting centres of the stepped queries, k = 3 (f0, f1, f2, f3).
START = [[0.2, 0.2, 0.2, 0.2], [0.5, 0.5, 0.5, 0.5], [0.9, 0.8, 0.7, 0.9]]
FAR = [*START[:2], [50.0, 50.0, 50.0, 50.0]]
WEIGHTS, INTERCEPT = [0.3, -0.2, 0.1, 0.4], -0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _centres(rows) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(f"CAST({x} AS DOUBLE)" for x in c) + ")" for k, c in enumerate(rows)) + ") t(cluster, c0, c1, c2, c3))"


_D2 = "(f0-c0)*(f0-c0) + (f1-c1)*(f1-c1) + (f2-c2)*(f2-c2) + (f3-c3)*(f3-c3)"


def _assigned(name: str, centres: str, by_shard: bool = False) -> str:
    """CTE of each point's nearest centre; ``by_shard`` if centres have a shard."""
    on = f"JOIN {centres} c ON q.shard = c.cshard" if by_shard else f", {centres} c"
    return f"{name} AS (SELECT id, shard, f0, f1, f2, f3, arg_min(cluster, (d2, cluster)) AS cluster, min(d2) AS d2 FROM (SELECT q.*, c.cluster, {_D2} AS d2 FROM q {on}) GROUP BY id, shard, f0, f1, f2, f3)"


_Q = SCALED.replace(", q AS (SELECT", ", q AS (SELECT row_number() OVER () AS id,")


def _moved(name: str, assigned: str, old: str, by_shard: bool = False) -> str:
    """CTE of new centres: means, empty clusters staying."""
    if by_shard:
        return (
            f"{name} AS (SELECT o.cshard, o.cluster, " + ", ".join(f"coalesce(m{i}, o.c{i}) AS c{i}" for i in range(4)) + f" FROM {old} o LEFT JOIN (SELECT shard, cluster, "
            + ", ".join(f"avg(f{i}) AS m{i}" for i in range(4)) + f" FROM {assigned} GROUP BY shard, cluster) a ON a.shard = o.cshard AND a.cluster = o.cluster)"
        )
    return (
        f"{name} AS (SELECT o.cluster, " + ", ".join(f"coalesce(m{i}, o.c{i}) AS c{i}" for i in range(4)) + f" FROM {old} o LEFT JOIN (SELECT cluster, "
        + ", ".join(f"avg(f{i}) AS m{i}" for i in range(4)) + f" FROM {assigned} GROUP BY cluster) a ON a.cluster = o.cluster)"
    )


def _rounded(table: str = "") -> str:
    return ", ".join(f"round({table}c{i}, 6) AS c{i}" for i in range(4))


def centres_frame(spark: SparkSession, centres: np.ndarray, **more) -> DataFrame:
    rows = [(k, *(float(x) for x in c), *more.values()) for k, c in enumerate(centres)]
    names = "cluster int, c0 double, c1 double, c2 double, c3 double" + "".join(f", {n} {'double' if isinstance(v, float) else 'bigint'}" for n, v in more.items())
    return spark.createDataFrame(rows, names).select("cluster", *(F.round(f"c{i}", 6).alias(f"c{i}") for i in range(4)), *(F.round(n, 4).alias(n) if isinstance(v, float) else n for n, v in more.items()))


@query(f"WITH {_Q}, {_assigned('a', _centres(START))} SELECT shard, cluster, count(*) AS n, round(sum(d2), 4) AS d2 FROM a GROUP BY ALL")
def kmeans_assign(spark, sf):
    got = kmeans.assign(scaled(spark, sf), POINT_FEATURES, START)
    return got.groupBy("shard", "cluster").agg(F.count("*").alias("n"), F.round(F.sum("d2"), 4).alias("d2"))


@query(f"WITH {_Q}, {_assigned('a', _centres(START))} SELECT shard, cluster, count(*) AS n, " + ", ".join(f"round(sum(f{i}), 4) AS sum_f{i}" for i in range(4)) + ", round(sum(d2), 4) AS wcss FROM a GROUP BY ALL")
def kmeans_stats(spark, sf):
    got = kmeans.cluster_stats(scaled(spark, sf), POINT_FEATURES, START, "shard")
    return got.select("shard", "cluster", "n", *(F.round(f"sum_{f}", 4).alias(f"sum_{f}") for f in POINT_FEATURES), F.round("wcss", 4).alias("wcss"))


@query(f"WITH {_Q}, {_assigned('a', _centres(START))} SELECT round(sum(d2), 4) AS wcss, count(*) AS n FROM a")
def kmeans_wcss(spark, sf):
    return kmeans.assign(scaled(spark, sf), POINT_FEATURES, START).agg(F.round(F.sum("d2"), 4).alias("wcss"), F.count("*").alias("n"))


def _lloyd_sql(start, rounds: int) -> str:
    parts, old = [_Q, f"k0 AS {_centres(start)}"], "k0"
    for t in range(rounds):
        parts += [_assigned(f"a{t}", old), _moved(f"k{t + 1}", f"a{t}", old)]
        old = f"k{t + 1}"
    return "WITH " + ", ".join(parts) + f" SELECT cluster, {_rounded()} FROM {old}"


@query(_lloyd_sql(START, 1))
def kmeans_lloyd_step(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "allreduce_mpi", rounds=1).centres)


@query(_lloyd_sql(START, 1).replace(f" SELECT cluster, {_rounded()} FROM k1", " SELECT round(sqrt(sum(" + " + ".join(f"pow(a.c{i} - b.c{i}, 2)" for i in range(4)) + ")), 6) AS shift FROM k1 a JOIN k0 b ON a.cluster = b.cluster"))
def kmeans_shift(spark, sf):
    """How far one exact step moves the centres (Frobenius norm)."""
    r = kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "allreduce_mpi", rounds=1)
    return spark.createDataFrame([(round(r.log[0]["shift"], 6),)], "shift double")


@query(_lloyd_sql(START, 3))
def kmeans_allreduce_t3(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "allreduce_mpi", rounds=3, tol=0.0).centres)


@query(_lloyd_sql(FAR, 2))
def kmeans_empty_cluster(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, FAR, "allreduce_mpi", rounds=2, tol=0.0).centres)


def _local_sql(epochs: int, start: str = "s0") -> tuple[list[str], str]:
    parts, old = [], start
    for e in range(epochs):
        parts += [_assigned(f"{start}a{e}", old, True), _moved(f"{start}m{e}", f"{start}a{e}", old, True)]
        old = f"{start}m{e}"
    return parts, old


_S0 = f"sh AS (SELECT shard AS cshard, count(*) AS rows FROM q GROUP BY shard), s0 AS (SELECT cshard, k.* FROM sh, {_centres(START)} k)"
_PERMS = "pm AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {i}, {p[i]})" for n, p in enumerate(permutations(range(3))) for i in range(3)) + ") t(perm, i, j))"


def _aligned(name: str, local: str) -> str:
    """CTEs that give shards' centres in the order of shard 0's (all 3! matchings are priced)."""
    return (
        f"{name}p AS (SELECT b.cshard, pm.perm, sum(sqrt(" + " + ".join(f"(a.c{i}-b.c{i})*(a.c{i}-b.c{i})" for i in range(4))
        + f")) AS cost FROM {local} a JOIN pm ON a.cluster = pm.i JOIN {local} b ON b.cluster = pm.j WHERE a.cshard = 0 GROUP BY ALL), "
        f"{name}b AS (SELECT cshard, arg_min(perm, (round(cost, 12), perm)) AS perm FROM {name}p GROUP BY cshard), "
        f"{name} AS (SELECT l.cshard, pm.i AS cluster, l.c0, l.c1, l.c2, l.c3 FROM {local} l JOIN {name}b x ON l.cshard = x.cshard JOIN pm ON pm.perm = x.perm AND pm.j = l.cluster)"
    )


def _mean(name: str, states: str) -> str:
    return f"{name} AS (SELECT cluster, " + ", ".join(f"sum(c{i} * rows) / sum(rows) AS c{i}" for i in range(4)) + f" FROM {states} JOIN sh USING (cshard) GROUP BY cluster)"


def _rounds_sql(rounds: int, epochs: int, aligned: bool) -> str:
    parts, start = [_Q, _S0, _PERMS], "s0"
    for r in range(rounds):
        steps, local = _local_sql(epochs, start)
        parts += steps
        if aligned:
            parts.append(_aligned(f"al{r}", local))
            local = f"al{r}"
        parts.append(_mean(f"g{r}", local))
        start = f"s{r + 1}"
        parts.append(f"{start} AS (SELECT cshard, g{r}.* FROM sh, g{r})")
    return "WITH " + ", ".join(parts) + f" SELECT cluster, {_rounded()} FROM g{rounds - 1}"


@query(_rounds_sql(2, 2, True))
def kmeans_fedavg_t2(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "fedavg_mpi", rounds=2, local_epochs=2, tol=0.0).centres)


@query(_rounds_sql(2, 2, True))
def kmeans_queue_t2(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "queue", rounds=2, local_epochs=2, tol=0.0).centres)


@query(_rounds_sql(2, 2, False))
def kmeans_hybrid_t2(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "hybrid", rounds=2, local_epochs=2).centres)


@query(_rounds_sql(1, 3, True))
def kmeans_merge_hungarian(spark, sf):
    """Independent shards, merged once."""
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "none", rounds=1, local_epochs=3).centres)


def _align_sql() -> str:
    steps, local = _local_sql(1)
    return "WITH " + ", ".join([_Q, _S0, _PERMS, *steps, _aligned("al", local)]) + f" SELECT CAST(cshard AS BIGINT) AS shard, CAST(cluster AS BIGINT) AS cluster, {_rounded()} FROM al"


@query(_align_sql())
def kmeans_align_k3(spark, sf):
    models = {s: np.array(START) for s in range(SHARDS)}
    stats = kmeans.shard_stats(scaled(spark, sf), POINT_FEATURES, models)
    local = {s: kmeans.moved(m, stats[s]) for s, m in models.items()}
    rows = [(s, k, *map(float, c)) for s, m in local.items() for k, c in enumerate(assignment.align(local[0], m))]
    return spark.createDataFrame(rows, "shard bigint, cluster bigint, c0 double, c1 double, c2 double, c3 double").select("shard", "cluster", *(F.round(f"c{i}", 6).alias(f"c{i}") for i in range(4)))


def _gossip_sql() -> str:
    steps, local = _local_sql(1)
    pairs = (
        "pp AS (SELECT a.cshard AS me, b.cshard AS peer, pm.perm, sum(sqrt(" + " + ".join(f"(a.c{i}-b.c{i})*(a.c{i}-b.c{i})" for i in range(4))
        + f")) AS cost FROM {local} a JOIN pm ON a.cluster = pm.i JOIN {local} b ON b.cluster = pm.j WHERE (b.cshard - a.cshard + 4) % 4 IN (0, 1, 3) GROUP BY ALL), "
        "pb AS (SELECT me, peer, arg_min(perm, (round(cost, 12), perm)) AS perm FROM pp GROUP BY me, peer), "
        f"mx AS (SELECT me, pm.i AS cluster, " + ", ".join(f"sum(l.c{i} * rows) / sum(rows) AS c{i}" for i in range(4)) + f" FROM pb JOIN pm ON pm.perm = pb.perm JOIN {local} l ON l.cshard = pb.peer AND l.cluster = pm.j JOIN sh ON sh.cshard = pb.peer GROUP BY me, pm.i)"
    )
    return "WITH " + ", ".join([_Q, _S0, _PERMS, *steps, pairs]) + f" SELECT CAST(me AS BIGINT) AS shard, CAST(cluster AS BIGINT) AS cluster, {_rounded()} FROM mx"


@query(_gossip_sql())
def kmeans_gossip_t1(spark, sf):
    got = kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "gossip", rounds=1, local_epochs=1)
    rows = [(s, k, *map(float, c)) for s, m in got.shards.items() for k, c in enumerate(m)]
    return spark.createDataFrame(rows, "shard bigint, cluster bigint, c0 double, c1 double, c2 double, c3 double").select("shard", "cluster", *(F.round(f"c{i}", 6).alias(f"c{i}") for i in range(4)))


def _async_sql() -> str:
    """One round in shard order: all shards start from version 0, so the update of shard s is s versions stale."""
    steps, local = _local_sql(1)
    parts, served = [_Q, _S0, *steps], None
    for s in range(SHARDS):
        own = f"(SELECT * FROM {local} WHERE cshard = {s})"
        if served is None:
            parts.append(f"v0 AS (SELECT cluster, c0, c1, c2, c3 FROM {own})")
        else:
            a = f"(0.5 / {1 + s})"
            parts.append(f"v{s} AS (SELECT v.cluster, " + ", ".join(f"(1 - {a}) * v.c{i} + {a} * n.c{i} AS c{i}" for i in range(4)) + f" FROM v{s - 1} v JOIN {own} n ON v.cluster = n.cluster)")
        served = f"v{s}"
    return "WITH " + ", ".join(parts) + f" SELECT cluster, {_rounded()} FROM {served}"


@query(_async_sql())
def kmeans_async_t1(spark, sf):
    return centres_frame(spark, kmeans.fit(scaled(spark, sf), POINT_FEATURES, START, "async", rounds=1, local_epochs=1).centres)


@query(f"WITH {_Q}, k0 AS {_centres(START)}, {_assigned('a', 'k0')}, {_moved('k1', 'a', 'k0')}, w AS (SELECT round(sum(d2), 4) AS wcss FROM a) SELECT cluster, {_rounded()}, wcss FROM k1, w")
def kmeans_reassign(spark, sf):
    centres, wcss = kmeans.reassign(scaled(spark, sf), POINT_FEATURES, np.array(START))
    return centres_frame(spark, centres, wcss=float(wcss))


@query()
def kmeans_all_modes(spark, sf):
    """Every mode, from seeded centres, with exact wcss over all points."""
    pts = scaled(spark, sf).cache()
    start = kmeans.initial_centres(pts, POINT_FEATURES, 3)
    rows = []
    for m in sync_modes.MODES:
        r = kmeans.fit(pts, POINT_FEATURES, start, m, rounds=3, local_epochs=2)
        rows.append((m, r.rounds, r.rows, round(r.wcss, 4)))
    pts.unpersist()
    return spark.createDataFrame(rows, "mode string, rounds int, rows bigint, wcss double")


@query()
def kmeans_gossip_adaptive(spark, sf):
    models = {s: np.array(START) for s in range(SHARDS)}
    pts = scaled(spark, sf)
    stats = kmeans.shard_stats(pts, POINT_FEATURES, models)
    got = kmeans.gossip_merge({s: (kmeans.moved(m, stats[s]), stats[s].wcss, stats[s].rows) for s, m in models.items()})
    return centres_frame(spark, got["centres"], total_rows=int(got["total_rows"]))


@query()
def kmeans_mllib_baseline(spark, sf):
    centres, wcss = kmeans.mllib_baseline(scaled(spark, sf), POINT_FEATURES, 3)
    return centres_frame(spark, centres, wcss=float(wcss))


@query()
def kmeans_seeded(spark, sf):
    """Global seed centres from a 5 % sample, added as anchors to a local fit."""
    pts = scaled(spark, sf)
    seeds, _ = kmeans.mllib_baseline(pts, POINT_FEATURES, 3, fraction=0.05)
    centres, wcss = kmeans.mllib_baseline(pts.where("shard = 0"), POINT_FEATURES, 3, anchors=seeds)
    return centres_frame(spark, centres, wcss=float(wcss))


# -- logistic regression ------------------------------------------------------------------------------------------------
_W = [f"CAST({w} AS DOUBLE)" for w in WEIGHTS]


def _z(w=_W, b=f"CAST({INTERCEPT} AS DOUBLE)") -> str:
    return f"({b} + " + " + ".join(f"f{i} * {w[i]}" for i in range(4)) + ")"


_LOSS = "greatest({z}, 0) + ln(1 + exp(-abs({z}))) - label * {z}"
_RES = "(1 / (1 + exp(-{z})) - label)"


def _grads(z: str) -> str:
    r = _RES.format(z=z)
    return ", ".join(f"avg({r} * f{i}) AS g{i}" for i in range(4)) + f", avg({r}) AS g4"


@query(f"WITH {SCALED} SELECT shard, count(*) AS n, round(avg({_LOSS.format(z=_z())}) + 0.005 * {sum(w * w for w in WEIGHTS)!r}, 6) AS loss FROM q GROUP BY shard")
def logreg_loss(spark, sf):
    rows = logreg.point_stats(scaled(spark, sf), POINT_FEATURES, "label", WEIGHTS, INTERCEPT, "shard")
    return rows.select("shard", "n", F.round(F.col("loss") / F.col("n") + 0.005 * sum(w * w for w in WEIGHTS), 6).alias("loss"))


@query(f"WITH {SCALED} SELECT shard, count(*) AS n, " + ", ".join(f"round(avg({_RES.format(z=_z())} * {x}), 6) AS g{i}" for i, x in enumerate(["f0", "f1", "f2", "f3", "1"])) + " FROM q GROUP BY shard")
def logreg_gradient(spark, sf):
    rows = logreg.point_stats(scaled(spark, sf), POINT_FEATURES, "label", WEIGHTS, INTERCEPT, "shard")
    return rows.select("shard", "n", *(F.round(F.col(f"g{i}") / F.col("n"), 6).alias(f"g{i}") for i in range(5)))


@query(f"WITH {SCALED} SELECT count(*) AS n, CAST(sum(CASE WHEN ({_z()} >= 0) = (label >= 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM q")
def logreg_accuracy(spark, sf):
    return logreg.point_stats(scaled(spark, sf), POINT_FEATURES, "label", WEIGHTS, INTERCEPT).select("n", "correct")


@query(f"WITH {SCALED}, s AS (SELECT label, least(greatest(1 / (1 + exp(-{_z()} * 40)), 1e-15), 1 - 1e-15) AS p FROM q) SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS xent FROM s")
def logreg_xent_clip(spark, sf):
    z = logreg.linear([F.col(f) for f in POINT_FEATURES], WEIGHTS, INTERCEPT) * 40
    p = F.least(F.greatest(logreg.sigmoid(z), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col("label")
    return scaled(spark, sf).agg(F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 6).alias("xent"))


@query(f"WITH {SCALED} SELECT CAST(CASE WHEN {_z()} >= 0 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, label, count(*) AS n FROM q GROUP BY ALL")
def logreg_predict(spark, sf):
    return logreg.predict(scaled(spark, sf), POINT_FEATURES, WEIGHTS, INTERCEPT).groupBy("prediction", "label").agg(F.count("*").alias("n"))


def _sgd_sql(epochs: int, rate: float, reg: float) -> str:
    parts = [SCALED, "w0 AS (SELECT 0.0 AS a0, 0.0 AS a1, 0.0 AS a2, 0.0 AS a3)"]
    for t in range(epochs):
        z = _z([f"a{i}" for i in range(4)], "0.0")
        step = logreg.cosine_rate(t, epochs, rate)
        parts.append(f"g{t} AS (SELECT shard, " + ", ".join(f"avg({_RES.format(z=z)} * f{i}) AS g{i}" for i in range(4)) + f" FROM q, w{t} GROUP BY shard)")
        parts.append(f"h{t} AS (SELECT " + ", ".join(f"avg(g{i}) AS g{i}" for i in range(4)) + f" FROM g{t})")
        parts.append(f"w{t + 1} AS (SELECT " + ", ".join(f"a{i} - {step!r} * (g{i} + {reg} * a{i}) AS a{i}" for i in range(4)) + f" FROM w{t}, h{t})")
    return "WITH " + ", ".join(parts) + " SELECT " + ", ".join(f"round(a{i}, 6) AS w{i}" for i in range(4)) + f" FROM w{epochs}"


@query(_sgd_sql(3, 0.5, 0.01))
def logreg_sgd_t3(spark, sf):
    r = logreg.fit(scaled(spark, sf), POINT_FEATURES, mode="allreduce_mpi", epochs=3, epoch_rate=0.5, reg=0.01, tol=0.0, standardise=False)
    return spark.createDataFrame([tuple(float(x) for x in r.weights)], "w0 double, w1 double, w2 double, w3 double").select(*(F.round(f"w{i}", 6).alias(f"w{i}") for i in range(4)))


@query(_sgd_sql(3, 0.5, 0.01).replace("w0 AS (SELECT 0.0 AS a0", "r AS (SELECT * FROM q), mo AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS d{i}" for i in range(4)) + " FROM r), q2 AS (SELECT shard, label, " + ", ".join(f"(f{i} - m{i}) / d{i} AS f{i}" for i in range(4)) + " FROM r, mo), w0 AS (SELECT 0.0 AS a0", 1).replace("FROM q, w", "FROM q2, w"))
def logreg_sgd_std_t3(spark, sf):
    """The exact mode as it is by default: features standardised by their global moments."""
    r = logreg.fit(scaled(spark, sf), POINT_FEATURES, mode="allreduce_mpi", epochs=3, epoch_rate=0.5, reg=0.01, tol=0.0)
    return spark.createDataFrame([tuple(float(x) for x in r.weights)], "w0 double, w1 double, w2 double, w3 double").select(*(F.round(f"w{i}", 6).alias(f"w{i}") for i in range(4)))


# One gradient step in every shard, from fixed weights, is each mode's local solve here.
_STEP = f"""st AS (SELECT shard, count(*) AS n, {_grads(_z())} FROM q GROUP BY shard),
lm AS (SELECT shard, n, """ + ", ".join(f"{WEIGHTS[i]} - 0.5 * (g{i} + 0.01 * {WEIGHTS[i]}) AS w{i}" for i in range(4)) + f", {INTERCEPT} - 0.5 * g4 AS w4 FROM st)"
_MEANS = ", ".join(f"round(sum(w{i} * n) / sum(n), 6) AS w{i}" for i in range(5))


def _fit(spark, sf, mode, rounds=1, standardise=False, **more):
    return logreg.fit(scaled(spark, sf), POINT_FEATURES, mode=mode, rounds=rounds, local_steps=1, solver="gd", rate=0.5, reg=0.01, start=np.array([*WEIGHTS, INTERCEPT]), standardise=standardise, **more)


def _model(spark, r):
    row = (*(float(x) for x in r.weights), r.intercept)
    return spark.createDataFrame([row], "w0 double, w1 double, w2 double, w3 double, w4 double").select(*(F.round(f"w{i}", 6).alias(f"w{i}") for i in range(5)))


@query(f"WITH {SCALED}, {_STEP} SELECT {_MEANS} FROM lm")
def logreg_fedavg_step(spark, sf):
    return _model(spark, _fit(spark, sf, "fedavg_mpi"))


@query(f"WITH {SCALED}, {_STEP} SELECT {_MEANS} FROM lm")
def logreg_queue_step(spark, sf):
    return _model(spark, _fit(spark, sf, "queue"))


@query(f"WITH {SCALED}, {_STEP} SELECT {_MEANS} FROM lm")
def logreg_hybrid_step(spark, sf):
    return _model(spark, _fit(spark, sf, "hybrid"))


@query(f"WITH {SCALED}, {_STEP} SELECT {_MEANS} FROM lm")
def logreg_nosync_merge(spark, sf):
    return _model(spark, _fit(spark, sf, "none"))


# The same step in a shard whose features are divided by their sample deviations in it, back in their own units.
_STEP_STD = f"""st AS (SELECT shard, count(*) AS n, {_grads(_z())}, """ + ", ".join(f"stddev_samp(f{i}) AS d{i}" for i in range(4)) + """ FROM q GROUP BY shard),
lm AS (SELECT shard, n, """ + ", ".join(f"{WEIGHTS[i]} - 0.5 * (g{i} / (d{i} * d{i}) + 0.01 * {WEIGHTS[i]}) AS w{i}" for i in range(4)) + f", {INTERCEPT} - 0.5 * g4 AS w4 FROM st)"


@query(f"WITH {SCALED}, {_STEP_STD} SELECT {_MEANS} FROM lm")
def logreg_none_std(spark, sf):
    return _model(spark, _fit(spark, sf, "none", rounds=3, standardise=None))


@query(f"WITH {SCALED}, {_STEP_STD} SELECT {_MEANS} FROM lm")
def logreg_queue_std(spark, sf):
    return _model(spark, _fit(spark, sf, "queue", standardise=None))


@query(
    f"WITH {SCALED}, {_STEP}, mx AS (SELECT a.shard, a.n, " + ", ".join(f"sum(b.w{i} * b.n) / sum(b.n) AS w{i}" for i in range(5))
    + f" FROM lm a JOIN lm b ON (b.shard - a.shard + 4) % 4 IN (0, 1, 3) GROUP BY a.shard, a.n) SELECT {_MEANS} FROM mx"
)
def logreg_gossip_step(spark, sf):
    return _model(spark, _fit(spark, sf, "gossip"))


@query(
    f"WITH {SCALED}, {_STEP}, g AS (SELECT {', '.join(f'sum(w{i} * n) / sum(n) AS v{i}' for i in range(5))} FROM lm) SELECT CAST(shard AS INT) AS worker_id, 1 AS iteration, n AS row_count, "
    f"round(sqrt({' + '.join(f'w{i} * w{i}' for i in range(4))}), 6) AS local_weight_norm, round(sqrt({' + '.join(f'v{i} * v{i}' for i in range(4))}), 6) AS weight_norm, round(v4, 6) AS intercept FROM lm, g"
)
def logreg_worker_log(spark, sf):
    """Each shard's round as the merged log holds it."""
    log = recorders.worker_rounds(spark, _fit(spark, sf, "fedavg_mpi"), "r", "fedavg_mpi", SHARDS, 0.01, 4)
    return log.select("worker_id", "iteration", "row_count", *(F.round(c, 6).alias(c) for c in ("local_weight_norm", "weight_norm", "intercept")))


@query("SELECT kernel, (SELECT count(*) FROM lineitem) AS n, true AS same FROM (VALUES ('kmeans_counts'), ('kmeans_sums'), ('kmeans_wcss'), ('logreg_loss'), ('logreg_gradient')) t(kernel)")
def kernel_equivalence(spark, sf):
    """The engine's expressions against numpy over blocks of rows: counts alike, sums to 1e-9 of their size."""
    pts = scaled(spark, sf).cache()
    block = kernels.block_stats(pts, POINT_FEATURES, "label", np.array(START), np.array([*WEIGHTS, INTERCEPT]))
    rows = kernels.row_stats(pts, POINT_FEATURES, "label", np.array(START), np.array([*WEIGHTS, INTERCEPT]))
    pts.unpersist()
    out = [(k, int(rows["kmeans_counts"].sum()), bool(np.allclose(rows[k], block[k], rtol=1e-9, atol=1e-8))) for k in rows]
    return spark.createDataFrame(out, "kernel string, n bigint, same boolean")


def _async_fold_sql() -> str:
    parts = [SCALED, _STEP, "v0 AS (SELECT w0, w1, w2, w3, w4 FROM lm WHERE shard = 0)"]
    for s in range(1, SHARDS):
        a = f"(0.5 / {1 + s})"
        parts.append(f"v{s} AS (SELECT " + ", ".join(f"(1 - {a}) * v.w{i} + {a} * n.w{i} AS w{i}" for i in range(5)) + f" FROM v{s - 1} v, (SELECT * FROM lm WHERE shard = {s}) n)")
    return "WITH " + ", ".join(parts) + " SELECT " + ", ".join(f"round(w{i}, 6) AS w{i}" for i in range(5)) + f" FROM v{SHARDS - 1}"


@query(_async_fold_sql())
def logreg_async_fold(spark, sf):
    return _model(spark, _fit(spark, sf, "async"))


@query(f"WITH {SCALED} SELECT f.name AS feature, round(avg(f.v), 6) AS mean, round(stddev_pop(f.v), 6) AS sd FROM (SELECT unnest([('f0', f0), ('f1', f1), ('f2', f2), ('f3', f3)]) AS f FROM q) t(f), LATERAL (SELECT f[1] AS name, f[2] AS v) f GROUP BY 1")
def standardise_stats(spark, sf):
    m = logreg.moments(scaled(spark, sf), POINT_FEATURES)
    return spark.createDataFrame([(k, *v) for k, v in m.items()], "feature string, mean double, sd double").select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


SQL["standardise_stats"] = f"WITH {SCALED} " + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(avg(f{i}), 6) AS mean, round(stddev_pop(f{i}), 6) AS sd FROM q" for i in range(4))


@query(f"WITH {SCALED}, s AS (SELECT avg(f0) AS m, stddev_pop(f0) AS d FROM q) SELECT label, round(sum((f0 - m) / d), 4) AS total, count(*) AS n FROM q, s GROUP BY label")
def standardised_head(spark, sf):
    pts = scaled(spark, sf)
    out = logreg.standardised(pts, ["f0"], logreg.moments(pts, ["f0"]))
    return out.groupBy("label").agg(F.round(F.sum("f0"), 4).alias("total"), F.count("*").alias("n"))


@query()
def logreg_fedavg_lbfgs(spark, sf):
    pts = scaled(spark, sf).cache()
    r = logreg.fit(pts, POINT_FEATURES, mode="fedavg_mpi", rounds=3)
    pts.unpersist()
    return _model(spark, r)


@query()
def logreg_all_modes(spark, sf):
    pts = scaled(spark, sf).cache()
    rows = []
    for m in sync_modes.MODES:
        r = logreg.fit(pts, POINT_FEATURES, mode=m, rounds=2, local_steps=3, epochs=5, epoch_rate=0.5)
        rows.append((m, r.rounds, r.rows, round(r.loss, 6), round(r.accuracy, 6)))
    pts.unpersist()
    return spark.createDataFrame(rows, "mode string, rounds int, rows bigint, loss double, accuracy double")


@query()
def logreg_mllib_baseline(spark, sf):
    m = logreg.mllib_baseline(scaled(spark, sf), POINT_FEATURES)
    row = (*(float(x) for x in m.coefficients), float(m.intercept))
    return spark.createDataFrame([row], "w0 double, w1 double, w2 double, w3 double, w4 double").select(*(F.round(f"w{i}", 6).alias(f"w{i}") for i in range(5)))
