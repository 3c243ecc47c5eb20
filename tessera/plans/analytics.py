"""Queries over run metrics: windows, aggregates, joins, sets and whole experiment reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import metrics as M
from tessera.operators import ranks
from tessera.plans.tables import CELLS, ITERATIONS, cells, iterations, table

QUERIES, SQL = {}, {}
RW = ["run", "worker"]
_SHARE = "(CASE WHEN iter_time_s > 0 THEN sync_time_s / iter_time_s ELSE 0.0 END)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n)


# -- windows -------------------------------------------------------------------------------------------------------------
_W = "OVER (PARTITION BY run, worker ORDER BY iteration)"


@query(f"WITH {ITERATIONS}, t AS (SELECT *, lag(wcss) {_W} AS p FROM m) SELECT run, worker, iteration, round(CASE WHEN p > 0 THEN (p - wcss) / p ELSE 0.0 END, 6) AS drop_rate FROM t")
def drop_rate_lag(spark, sf):
    return M.drop_rate(iterations(spark, sf), "wcss", RW, "iteration").select(*RW, "iteration", r("drop_rate").alias("drop_rate"))


@query(f"WITH {ITERATIONS}, t AS (SELECT *, lag(loss) {_W} AS p FROM m) SELECT run, worker, iteration, round(CASE WHEN p > 0 THEN (p - loss) / p ELSE 0.0 END, 6) AS drop_rate FROM t")
def loss_drop_rate(spark, sf):
    return M.drop_rate(iterations(spark, sf), "loss", RW, "iteration").select(*RW, "iteration", r("drop_rate").alias("drop_rate"))


@query(f"WITH {ITERATIONS}, t AS (SELECT *, first_value(grad_norm) {_W} AS p FROM m) SELECT run, worker, iteration, round(grad_norm / CASE WHEN p = 0 THEN 1.0 ELSE p END, 6) AS decay FROM t")
def decay_first_value(spark, sf):
    return M.decay(iterations(spark, sf), "grad_norm", RW, "iteration").select(*RW, "iteration", r("decay").alias("decay"))


@query(f"WITH {ITERATIONS} SELECT run, iteration, round(CASE WHEN count(*) > 1 THEN max(iter_time_s) - min(iter_time_s) ELSE 0.0 END, 6) AS rank_variance_s FROM m GROUP BY run, iteration")
def rank_variance(spark, sf):
    spread = F.when(F.count("*") > 1, F.max("iter_time_s") - F.min("iter_time_s")).otherwise(F.lit(0.0))
    return iterations(spark, sf).groupBy("run", "iteration").agg(r(spread).alias("rank_variance_s"))


@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY run, worker) // 2 AS h FROM m) "
    "SELECT run, worker, round(avg(CASE WHEN i <= h THEN iter_time_s END), 6) AS first_half, round(avg(CASE WHEN i > h THEN iter_time_s END), 6) AS second_half FROM t GROUP BY run, worker"
)
def half_avg(spark, sf):
    return M.half_averages(iterations(spark, sf), "iter_time_s", RW, "iteration").select(*RW, r("first_half").alias("first_half"), r("second_half").alias("second_half"))


@query(f"WITH {ITERATIONS} SELECT run, worker, iteration, round(sum(iter_time_s) OVER (PARTITION BY run, worker ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS elapsed FROM m")
def cum_elapsed(spark, sf):
    return M.cumulative(iterations(spark, sf), "iter_time_s", RW, "iteration").select(*RW, "iteration", r("elapsed", 4).alias("elapsed"))


@query(f"WITH {ITERATIONS}, t AS (SELECT *, lead(loss) {_W} AS n FROM m) SELECT run, worker, iteration, round(n, 6) AS loss_after FROM t WHERE n IS NOT NULL")
def loss_after_lead(spark, sf):
    return M.following(iterations(spark, sf), "loss", RW, "iteration", "loss_after").select(*RW, "iteration", r("loss_after").alias("loss_after"))


@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, min(sync_time_s) OVER (PARTITION BY run, iteration) AS transfer FROM m) "
    "SELECT run, worker, round(sum(transfer), 4) AS transfer, round(sum(sync_time_s - transfer), 4) AS wait, round(sum(sync_time_s - transfer) / sum(sync_time_s), 6) AS wait_share FROM t GROUP BY run, worker"
)
def transfer_wait(spark, sf):
    t = M.transfer_and_wait(iterations(spark, sf), "sync_time_s", ["run", "iteration"])
    return t.groupBy(*RW).agg(r(F.sum("transfer"), 4).alias("transfer"), r(F.sum("wait"), 4).alias("wait"), r(F.sum("wait") / F.sum("sync_time_s")).alias("wait_share"))


@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, sum(iter_time_s) OVER (PARTITION BY run, worker ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS el FROM m) SELECT run, worker, round(min(CASE WHEN loss <= 0.05 THEN el END), 4) AS ttt FROM t GROUP BY run, worker"
)
def time_to_target(spark, sf):
    t = M.cumulative(iterations(spark, sf), "iter_time_s", RW, "iteration")
    return M.time_to_target(t, "loss", "elapsed", 0.05, RW).select(*RW, r("ttt", 4).alias("ttt"))


@query(f"WITH {ITERATIONS}, t AS (SELECT *, row_number() {_W} AS i FROM m WHERE iteration % 100 <> 37 OR worker <> 2) SELECT run, worker, bool_and(iteration = i) AS contiguous, count(*) AS n FROM t GROUP BY run, worker")
def round_contiguity(spark, sf):
    return M.contiguous(iterations(spark, sf).where("iteration % 100 <> 37 or worker <> 2"), "iteration", RW)


@query(f"WITH {ITERATIONS}, t AS (SELECT *, row_number() {_W} AS i, lag(weight_norm) {_W} AS p FROM m) SELECT run, worker, bool_or(abs(weight_norm - p) > 1e-6) AS moving FROM t WHERE i > 1 GROUP BY run, worker")
def weights_moving(spark, sf):
    w = Window.partitionBy(*RW).orderBy("iteration")
    t = iterations(spark, sf).withColumn("i", F.row_number().over(w)).withColumn("p", F.lag("weight_norm").over(w)).where("i > 1")
    return t.groupBy(*RW).agg(F.bool_or(F.abs(F.col("weight_norm") - F.col("p")) > 1e-6).alias("moving"))


@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, row_number() OVER (PARTITION BY run, worker ORDER BY iteration DESC) AS d, first_value(iter_time_s) {_W} AS f, count(*) OVER (PARTITION BY run, worker) AS n FROM m) "
    "SELECT run, worker, round(median(iter_time_s) / max(f), 6) AS ratio FROM t WHERE d <= 3 AND n > 3 GROUP BY run, worker"
)
def late_time_ratio(spark, sf):
    w = Window.partitionBy(*RW)
    t = iterations(spark, sf).withColumns({"d": F.row_number().over(w.orderBy(F.desc("iteration"))), "f": F.first_value("iter_time_s").over(w.orderBy("iteration")), "n": F.count("*").over(w)})
    return t.where("d <= 3 and n > 3").groupBy(*RW).agg(r(F.median("iter_time_s") / F.max("f")).alias("ratio"))


_V = "OVER (PARTITION BY run, worker ORDER BY iteration)"


@query(f"WITH {ITERATIONS}, t AS (SELECT *, [weight_norm, loss, grad_norm] AS v FROM m), u AS (SELECT *, lag(v) {_V} AS p FROM t) SELECT run, worker, iteration, round(sqrt((v[1]-p[1])**2 + (v[2]-p[2])**2 + (v[3]-p[3])**2), 6) AS delta FROM u WHERE p IS NOT NULL")
def weight_delta(spark, sf):
    from tessera.functions.linalg import squared_distance

    w = Window.partitionBy(*RW).orderBy("iteration")
    t = iterations(spark, sf).withColumn("v", F.array("weight_norm", "loss", "grad_norm")).withColumn("p", F.lag("v").over(w)).where("p is not null")
    return t.select(*RW, "iteration", r(F.sqrt(squared_distance(F.col("v"), F.col("p")))).alias("delta"))


@query(f"WITH {ITERATIONS}, t AS (SELECT *, lag(loss) {_V} AS p FROM m) SELECT run, worker, min(iteration) AS stop_at FROM t WHERE abs(loss - p) <= 0.01 * greatest(abs(p), 1e-12) GROUP BY run, worker")
def early_stop(spark, sf):
    w = Window.partitionBy(*RW).orderBy("iteration")
    t = iterations(spark, sf).withColumn("p", F.lag("loss").over(w)).where(F.abs(F.col("loss") - F.col("p")) <= 0.01 * F.greatest(F.abs("p"), F.lit(1e-12)))
    return t.groupBy(*RW).agg(F.min("iteration").alias("stop_at"))


_MEANS = "a AS (SELECT wid, cores, avg(wall) AS wall, quantile_cont(rss, 0.95) AS p95, max(rss) AS peak, count(*) AS reps FROM c GROUP BY wid, cores)"


@query(f"WITH {CELLS}, {_MEANS}, b AS (SELECT *, min(wall) OVER (PARTITION BY wid) AS best FROM a) SELECT wid, min(cores) AS knee, round(arg_min(wall, cores), 4) AS at_knee FROM b WHERE wall <= best * 1.1 GROUP BY wid")
def knee(spark, sf):
    a = cells(spark, sf).groupBy("wid", "cores").agg(F.avg("wall").alias("wall"))
    return M.knee(a, "wall", "cores", ["wid"], 0.1).select("wid", "knee", r("at_knee", 4).alias("at_knee"))


def _ttt(spark, sf) -> DataFrame:
    t = M.cumulative(iterations(spark, sf), "iter_time_s", RW, "iteration")
    return M.time_to_target(t, "loss", "elapsed", 0.05, RW).where("ttt is not null")


_TTT = f"{ITERATIONS}, t AS (SELECT *, sum(iter_time_s) OVER (PARTITION BY run, worker ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS el FROM m), tt AS (SELECT run, worker, min(CASE WHEN loss <= 0.05 THEN el END) AS ttt FROM t GROUP BY run, worker HAVING min(CASE WHEN loss <= 0.05 THEN el END) IS NOT NULL)"
_IQR = "s AS (SELECT run, median(ttt) AS med, list_sort(list(ttt)) AS v, count(*) AS n FROM tt GROUP BY run), i AS (SELECT *, v[1 + CAST(floor(0.25 * (n - 1)) AS INT)] AS lo, v[1 + CAST(round_even(0.75 * (n - 1), 0) AS INT)] AS hi FROM s)"


def _iqr(spark, sf) -> DataFrame:
    return ranks.medians(_ttt(spark, sf), ["run"], "ttt", "med", lo=ranks.LOWER_QUARTILE, hi=ranks.UPPER_QUARTILE)


@query(f"WITH {_TTT}, {_IQR}, k AS (SELECT *, row_number() OVER (ORDER BY med, run) AS rank, lead(lo) OVER (ORDER BY med, run) AS next_lo FROM i) SELECT run, rank, round(med, 4) AS med, CASE WHEN hi < next_lo THEN 'SEPARABLE' ELSE 'NOT SEPARABLE' END AS verdict FROM k")
def rank_separable(spark, sf):
    w = Window.orderBy("med", "run")  # a row per mode
    k = _iqr(spark, sf).withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("next_lo", F.lead("lo").over(w))
    return k.select("run", "rank", r("med", 4).alias("med"), F.when(F.col("hi") < F.col("next_lo"), "SEPARABLE").otherwise("NOT SEPARABLE").alias("verdict"))


@query(f"WITH {ITERATIONS}, a AS (SELECT run, worker, min(wcss) AS w FROM m GROUP BY run, worker) SELECT run, worker, round((w - min(w) OVER (PARTITION BY worker)) / min(w) OVER (PARTITION BY worker) * 100, 6) AS pct FROM a")
def rel_to_best(spark, sf):
    best = F.min("w").over(Window.partitionBy("worker"))
    return iterations(spark, sf).groupBy(*RW).agg(F.min("wcss").alias("w")).select(*RW, r((F.col("w") - best) / best * 100).alias("pct"))


@query(f"WITH {ITERATIONS}, t AS (SELECT *, 100.0 + worker AS wall, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY run, worker) AS n FROM m) SELECT run, worker, iteration, round(1 + i * (wall - 1) / n, 6) AS t_s FROM t")
def trace_times(spark, sf):
    t = iterations(spark, sf).withColumn("wall", 100.0 + F.col("worker"))
    return M.rebuilt_trace(t, RW, "iteration", "wall").select(*RW, "iteration", r("t_s").alias("t_s"))


# -- aggregates ----------------------------------------------------------------------------------------------------------
@query(f"WITH {ITERATIONS} SELECT run, round(avg(iter_time_s), 6) AS mean, round(max(iter_time_s), 6) AS max, round(min(iter_time_s), 6) AS min, round(stddev_pop(iter_time_s), 6) AS std FROM m GROUP BY run")
def describe_pop(spark, sf):
    return iterations(spark, sf).groupBy("run").agg(r(F.avg("iter_time_s")).alias("mean"), r(F.max("iter_time_s")).alias("max"), r(F.min("iter_time_s")).alias("min"), r(F.stddev_pop("iter_time_s")).alias("std"))


@query(f"WITH {ITERATIONS} SELECT run, iteration, round(avg({_SHARE} * 100), 4) AS pct_mean, round(max({_SHARE} * 100), 4) AS pct_max, round(min({_SHARE} * 100), 4) AS pct_min, round(avg(wcss), 6) AS wcss_mean FROM m GROUP BY run, iteration")
def across_ranks(spark, sf):
    pct = scalars.ratio(F.col("sync_time_s"), F.col("iter_time_s")) * 100
    return iterations(spark, sf).withColumn("p", pct).groupBy("run", "iteration").agg(r(F.avg("p"), 4).alias("pct_mean"), r(F.max("p"), 4).alias("pct_max"), r(F.min("p"), 4).alias("pct_min"), r(F.avg("wcss")).alias("wcss_mean"))


@query(f"WITH {CELLS} SELECT wid, cores, arg_min(wall, run_id) AS first_wall, round(avg(wall), 4) AS mean_wall, max(rss) AS max_rss, count(*) AS n, round(stddev_samp(wall), 4) AS sd FROM c GROUP BY wid, cores")
def run_driver_rollup(spark, sf):
    return cells(spark, sf).groupBy("wid", "cores").agg(F.min_by("wall", "run_id").alias("first_wall"), r(F.avg("wall"), 4).alias("mean_wall"), F.max("rss").alias("max_rss"), F.count("*").alias("n"), r(F.stddev_samp("wall"), 4).alias("sd"))


@query(f"WITH {CELLS}, s AS (SELECT wid, list_sort(list(rss)) AS v, count(*) AS n FROM c GROUP BY wid) SELECT wid, v[1 + CAST(round_even(0.95 * (n - 1), 0) AS INT)] AS p95, v[1 + CAST(round_even(0.5 * (n - 1), 0) AS INT)] AS p50 FROM s")
def pctl_nearest_rank(spark, sf):
    return ranks.at_ranks(cells(spark, sf), ["wid"], "rss", {"p95": ranks.nearest(95), "p50": ranks.nearest(50)}).drop("n")


@query(f"WITH {_TTT}, {_IQR} SELECT run, round(med, 4) AS med, round(lo, 4) AS lo, round(hi, 4) AS hi FROM i")
def median_iqr(spark, sf):
    return _iqr(spark, sf).select("run", *(r(c, 4).alias(c) for c in ("med", "lo", "hi")))


@query(f"WITH {CELLS}, v AS (SELECT wid, cores, count(*) AS n, stddev_samp(wall) / avg(wall) AS cv FROM c GROUP BY wid, cores HAVING count(*) >= 3) SELECT wid, round(median(cv), 6) AS median_cv FROM v GROUP BY wid")
def noise_cv(spark, sf):
    return M.variation(cells(spark, sf), "wall", ["wid", "cores"]).groupBy("wid").agg(r(F.median("cv")).alias("median_cv"))


@query(f"WITH {ITERATIONS} SELECT run, count(DISTINCT worker) AS workers, count(DISTINCT user_id) AS users FROM m GROUP BY run")
def distinct_runs(spark, sf):
    return iterations(spark, sf).groupBy("run").agg(F.countDistinct("worker").alias("workers"), F.countDistinct("user_id").alias("users"))


_FRACTION = "CASE WHEN iter_time_s > 0 THEN spark_time_s / iter_time_s ELSE 0.0 END"
_CLASS = f"CASE WHEN {_FRACTION} > 0.6 THEN 'compute' WHEN {_FRACTION} < 0.4 THEN 'sync' ELSE 'balanced' END"


@query(
    f"WITH {ITERATIONS}, k AS (SELECT run, {_CLASS} AS c FROM m), n AS (SELECT run, count(*) FILTER (c = 'compute') AS a, count(*) FILTER (c = 'sync') AS b, count(*) FILTER (c = 'balanced') AS d FROM k GROUP BY run) "
    "SELECT run, CASE WHEN a >= b AND a >= d THEN 'compute' WHEN b >= d THEN 'sync' ELSE 'balanced' END AS mode FROM n"
)
def majority_class(spark, sf):
    k = iterations(spark, sf).withColumn("c", scalars.bottleneck(scalars.ratio(F.col("spark_time_s"), F.col("iter_time_s"))))
    n = k.groupBy("run").agg(*(F.count_if(F.col("c") == c).alias(c) for c in ("compute", "sync", "balanced")))
    return n.select("run", F.when((F.col("compute") >= F.col("sync")) & (F.col("compute") >= F.col("balanced")), "compute").when(F.col("sync") >= F.col("balanced"), "sync").otherwise("balanced").alias("mode"))


@query(f"WITH {CELLS} SELECT wid, " + ", ".join(f"arg_min(CASE WHEN cores = {k} THEN wall END, CASE WHEN cores = {k} THEN run_id END) AS \"{k}\"" for k in (1, 2, 3, 4)) + " FROM c GROUP BY wid")
def pivot_wall(spark, sf):
    return cells(spark, sf).groupBy("wid").pivot("cores", [1, 2, 3, 4]).agg(F.min_by("wall", "run_id"))


@query(f"WITH {ITERATIONS}, z AS (SELECT *, CASE WHEN run = 'view' THEN 0 ELSE row_count END AS w FROM m) SELECT run, round(coalesce(sum(loss * w) / nullif(sum(w), 0), avg(loss), 0.0), 6) AS mean FROM z GROUP BY run")
def weighted_mean_guarded(spark, sf):
    z = iterations(spark, sf).withColumn("w", F.when(F.col("run") == "view", 0).otherwise(F.col("row_count")))
    return z.groupBy("run").agg(r(M.weighted_mean("loss", "w")).alias("mean"))


@query(f"WITH {ITERATIONS} SELECT run, iteration, round(avg(weight_norm), 6) AS mean, min(weight_norm) AS min, max(weight_norm) AS max FROM m WHERE exit_code = 0 GROUP BY run, iteration")
def convergence_spread(spark, sf):
    return iterations(spark, sf).where("exit_code = 0").groupBy("run", "iteration").agg(r(F.avg("weight_norm")).alias("mean"), F.min("weight_norm").alias("min"), F.max("weight_norm").alias("max"))


@query(f"WITH {ITERATIONS} SELECT run, round(avg(staleness), 6) AS mean, max(staleness) AS max, round(sum(sync_time_s) / count(DISTINCT worker), 6) AS sync_per_worker FROM m GROUP BY run")
def staleness_and_sync(spark, sf):
    return iterations(spark, sf).groupBy("run").agg(r(F.avg("staleness")).alias("mean"), F.max("staleness").alias("max"), r(F.sum("sync_time_s") / F.countDistinct("worker"), 6).alias("sync_per_worker"))


@query(f"WITH {ITERATIONS} SELECT run, worker, round(sum(row_count) / sum(iter_time_s), 4) AS throughput, round(avg({_SHARE}) * 100, 4) AS sync_mean, round(max({_SHARE}) * 100, 4) AS sync_max FROM m GROUP BY run, worker")
def throughput(spark, sf):
    share = scalars.ratio(F.col("sync_time_s"), F.col("iter_time_s"))
    return iterations(spark, sf).withColumn("s", share).groupBy(*RW).agg(r(F.sum("row_count") / F.sum("iter_time_s"), 4).alias("throughput"), r(F.avg("s") * 100, 4).alias("sync_mean"), r(F.max("s") * 100, 4).alias("sync_max"))


@query(f"WITH {ITERATIONS} SELECT run, count(*) AS n, round(avg(iter_time_s), 6) AS avg_s, round(max(iter_time_s), 6) AS max_s FROM m WHERE exit_code = 0 GROUP BY run")
def worker_timing(spark, sf):
    return iterations(spark, sf).where("exit_code = 0").groupBy("run").agg(F.count("*").alias("n"), r(F.avg("iter_time_s")).alias("avg_s"), r(F.max("iter_time_s")).alias("max_s"))


@query(f"WITH {ITERATIONS} SELECT run, worker, round(arg_max(wcss, iteration), 6) AS last_wcss, round(arg_max(sync_time_s, iteration) / nullif(arg_max(iter_time_s, iteration), 0) * 100, 4) AS overhead FROM m GROUP BY run, worker")
def last_iteration(spark, sf):
    last = iterations(spark, sf).groupBy(*RW).agg(F.max_by(F.struct("wcss", "sync_time_s", "iter_time_s"), "iteration").alias("l"))
    return last.select(*RW, r("l.wcss").alias("last_wcss"), r(F.try_divide("l.sync_time_s", "l.iter_time_s") * 100, 4).alias("overhead"))


# -- joins and sets ------------------------------------------------------------------------------------------------------
@query(f"WITH {CELLS}, b AS (SELECT wid, cores, count(*) AS runs FROM c GROUP BY wid, cores), d AS (SELECT wid, cores, round(avg(rss), 4) AS rss FROM c WHERE driver = 0 AND cores <> 3 GROUP BY wid, cores) SELECT b.wid, b.cores, runs, rss FROM b LEFT JOIN d ON b.wid = d.wid AND b.cores = d.cores")
def left_join_rollup(spark, sf):
    c = cells(spark, sf)
    base = c.groupBy("wid", "cores").agg(F.count("*").alias("runs"))
    return base.join(c.where("driver = 0 and cores <> 3").groupBy("wid", "cores").agg(r(F.avg("rss"), 4).alias("rss")), ["wid", "cores"], "left")


_GRID = "g AS (SELECT wid, k AS cores, rep FROM (SELECT DISTINCT c_mktsegment AS wid FROM customer), (SELECT unnest([1, 2, 3, 4, 5]) AS k), (SELECT unnest([0, 1, 2]) AS rep) WHERE NOT (k = 5 AND rep > 0))"


def _grid(spark, sf) -> DataFrame:
    levels = lambda n: F.explode(F.array(*[F.lit(k) for k in n]))
    wid = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("wid")).distinct()
    grid = wid.withColumn("cores", levels(range(1, 6))).withColumn("rep", levels(range(3)))
    return grid.where(~((F.col("cores") == 5) & (F.col("rep") > 0)))


@query(f"WITH {_GRID} SELECT * FROM g")
def grid_cross(spark, sf):
    """A grid of parameter levels: its size is the product of a few lists."""
    return _grid(spark, sf)


@query(f"WITH {CELLS}, {_GRID}, d AS (SELECT DISTINCT wid, cores, driver AS rep FROM c WHERE wall > 80000) SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.wid = g.wid AND d.cores = g.cores AND d.rep = g.rep)")
def anti_resume(spark, sf):
    done = cells(spark, sf).where("wall > 80000").select("wid", F.col("cores").cast("int").alias("cores"), F.col("driver").cast("int").alias("rep"))
    return M.remaining(_grid(spark, sf), done, ["wid", "cores", "rep"])


@query(
    f"WITH {CELLS}, f AS (SELECT wid, cores, driver + 1 AS workers, median(wall) AS med FROM c WHERE cores <= 2 GROUP BY ALL), b AS (SELECT wid, cores, median(wall) AS base FROM c GROUP BY ALL) "
    "SELECT f.wid, f.cores, workers, round(base / nullif(med, 0), 6) AS speedup FROM f JOIN b ON b.wid = f.wid AND b.cores = f.cores * f.workers"
)
def fair_baseline_match(spark, sf):
    c = cells(spark, sf)
    fw = ranks.medians(c.where("cores <= 2").withColumn("workers", F.col("driver") + 1), ["wid", "cores", "workers"], "wall", "med")
    base = ranks.medians(c, ["wid", "cores"], "wall", "base").select(F.col("wid").alias("bw"), F.col("cores").alias("bc"), "base")
    hit = fw.join(base, (F.col("bw") == F.col("wid")) & (F.col("bc") == F.col("cores") * F.col("workers")))
    return hit.select("wid", "cores", "workers", r(F.try_divide("base", "med")).alias("speedup"))


_TOLS = "(SELECT unnest([0.05, 0.1, 0.1 + 1e-12, 0.2]) AS tol)"


@query(f"WITH {CELLS}, l AS (SELECT DISTINCT wid, tol FROM c, {_TOLS}) SELECT wid, count(*) AS n FROM l WHERE abs(tol - 0.1) < 1e-9 GROUP BY wid")
def tolerance_label_lookup(spark, sf):
    tols = F.explode(F.array(*[F.lit(t) for t in (0.05, 0.1, 0.1 + 1e-12, 0.2)])).alias("tol")
    labels = cells(spark, sf).select("wid").distinct().select("wid", tols)
    return M.tolerance_lookup(labels, 0.1).groupBy("wid").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, a AS (SELECT wid, cores, avg(wall) AS w FROM c GROUP BY wid, cores) SELECT a.wid, a.cores, round((a.w - b.w) / b.w * 100, 4) AS slowdown_pct FROM a LEFT JOIN a b ON a.wid = b.wid AND b.cores = 4")
def slowdown_lookup(spark, sf):
    a = cells(spark, sf).groupBy("wid", "cores").agg(F.avg("wall").alias("w"))
    base = a.where("cores = 4").select(F.col("wid").alias("bw"), F.col("w").alias("b"))
    return a.join(base, F.col("wid") == F.col("bw"), "left").select("wid", "cores", r((F.col("w") - F.col("b")) / F.col("b") * 100, 4).alias("slowdown_pct"))


@query(f"WITH {ITERATIONS}, t AS (SELECT run, iteration, max(CASE WHEN worker = 0 THEN iter_time_s END) AS a, max(CASE WHEN worker = 1 THEN iter_time_s END) AS b FROM m GROUP BY run, iteration) SELECT run, iteration, round(a - b, 6) AS diff FROM t WHERE a IS NOT NULL AND b IS NOT NULL")
def rank_aligned(spark, sf):
    it = iterations(spark, sf)
    a, b = (it.where(F.col("worker") == k).select("run", "iteration", F.col("iter_time_s").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, ["run", "iteration"]).select("run", "iteration", r(F.col("a") - F.col("b")).alias("diff"))


@query("SELECT 'a' AS part, event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'b' AS part, event_id FROM events WHERE event_id % 2 = 0")
def union_runs(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return e.where("event_id % 3 = 0").select(F.lit("a").alias("part"), "event_id").unionByName(e.where("event_id % 2 = 0").select(F.lit("b").alias("part"), "event_id"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 UNION SELECT event_id FROM events WHERE event_id % 2 = 0")
def distinct_union(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return e.where("event_id % 3 = 0").union(e.where("event_id % 2 = 0")).distinct()


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) SELECT DISTINCT word FROM w WHERE doc_id % 2 = 0 AND word <> '' EXCEPT SELECT word FROM w WHERE doc_id % 2 = 1")
def except_words(spark, sf):
    from tessera.operators.wordcount import words

    d = table(spark, sf, "documents")
    return words(d.where("doc_id % 2 = 0"), "text").distinct().join(words(d.where("doc_id % 2 = 1"), "text").distinct(), "word", "left_anti")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_first(spark, sf):
    return M.first_rows(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


# -- experiments ---------------------------------------------------------------------------------------------------------
@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, lag(wcss) {_W} AS p, {_CLASS} AS c FROM m), n AS (SELECT run, iteration, max(iter_time_s) - min(iter_time_s) AS v FROM m GROUP BY run, iteration) "
    f"SELECT t.run, t.worker, round(avg({_FRACTION}), 6) AS spark_fraction, round(avg(CASE WHEN p > 0 THEN (p - wcss) / p ELSE 0.0 END), 6) AS drop_rate, round(avg(n.v), 6) AS variance_s, "
    "count(*) FILTER (c = 'compute') AS compute, count(*) FILTER (c = 'sync') AS sync FROM t JOIN n ON t.run = n.run AND t.iteration = n.iteration GROUP BY t.run, t.worker"
)
def bottleneck_summary(spark, sf):
    it = M.drop_rate(iterations(spark, sf), "wcss", RW, "iteration").withColumn("f", scalars.ratio(F.col("spark_time_s"), F.col("iter_time_s")))
    it = it.withColumn("c", scalars.bottleneck(F.col("f")))
    spread = iterations(spark, sf).groupBy("run", "iteration").agg((F.max("iter_time_s") - F.min("iter_time_s")).alias("v"))
    return it.join(spread, ["run", "iteration"]).groupBy(*RW).agg(
        r(F.avg("f")).alias("spark_fraction"), r(F.avg("drop_rate")).alias("drop_rate"), r(F.avg("v")).alias("variance_s"),
        F.count_if(F.col("c") == "compute").alias("compute"), F.count_if(F.col("c") == "sync").alias("sync"),
    )


@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY run, worker) // 2 AS h, first_value(grad_norm) {_W} AS g FROM m) "
    "SELECT run, round(avg(iter_time_s), 6) AS avg_iter, round(avg(CASE WHEN i <= h THEN spark_time_s END), 6) AS first_spark, round(avg(CASE WHEN i > h THEN spark_time_s END), 6) AS second_spark, "
    "round(avg(grad_norm / CASE WHEN g = 0 THEN 1.0 ELSE g END), 6) AS decay, 540000 AS dataset_rows, 5 AS ranks FROM t GROUP BY run"
)
def feature_matrix(spark, sf):
    w = Window.partitionBy(*RW)
    t = M.decay(iterations(spark, sf), "grad_norm", RW, "iteration").withColumn("i", F.row_number().over(w.orderBy("iteration"))).withColumn("h", F.floor(F.count("*").over(w) / 2))
    return t.groupBy("run").agg(
        r(F.avg("iter_time_s")).alias("avg_iter"), r(F.avg(F.when(F.col("i") <= F.col("h"), F.col("spark_time_s")))).alias("first_spark"),
        r(F.avg(F.when(F.col("i") > F.col("h"), F.col("spark_time_s")))).alias("second_spark"), r(F.avg("decay")).alias("decay"), F.lit(540000).alias("dataset_rows"), F.lit(5).alias("ranks"),
    )


@query(
    f"WITH {ITERATIONS}, n AS (SELECT run, iteration, max(iter_time_s) - min(iter_time_s) AS v FROM m GROUP BY run, iteration), v AS (SELECT run, avg(v) AS v FROM n GROUP BY run), "
    f"k AS (SELECT run, avg({_FRACTION}) AS f FROM m GROUP BY run) SELECT k.run, CASE WHEN f > 0.6 THEN 'INCREASE cores' WHEN f < 0.4 THEN 'REDUCE ranks' ELSE 'HOLD' END AS action, v.v > 0.5 AS straggler FROM k JOIN v ON k.run = v.run"
)
def allocator_action(spark, sf):
    it = iterations(spark, sf)
    v = it.groupBy("run", "iteration").agg((F.max("iter_time_s") - F.min("iter_time_s")).alias("v")).groupBy("run").agg(F.avg("v").alias("v"))
    k = it.groupBy("run").agg(scalars.bottleneck(F.avg(scalars.ratio(F.col("spark_time_s"), F.col("iter_time_s")))).alias("c"))
    action = F.when(F.col("c") == "compute", "INCREASE cores").when(F.col("c") == "sync", "REDUCE ranks").otherwise("HOLD")
    return k.join(v, "run").select("run", action.alias("action"), (F.col("v") > 0.5).alias("straggler"))


@query(f"WITH {ITERATIONS} SELECT run, count(DISTINCT worker) AS workers, round(sum(iter_time_s), 4) AS wall, round(sum(sync_time_s) / count(DISTINCT worker), 6) AS sync_s, round(avg(staleness), 6) AS stale, max(iteration) AS rounds FROM m WHERE exit_code = 0 GROUP BY run")
def sync_summary(spark, sf):
    return iterations(spark, sf).where("exit_code = 0").groupBy("run").agg(
        F.countDistinct("worker").alias("workers"), r(F.sum("iter_time_s"), 4).alias("wall"), r(F.sum("sync_time_s") / F.countDistinct("worker"), 6).alias("sync_s"), r(F.avg("staleness")).alias("stale"), F.max("iteration").alias("rounds")
    )


@query(f"WITH {ITERATIONS}, x AS (SELECT run, worker, min(loss) AS b FROM m GROUP BY run, worker), y AS (SELECT run, median(b) AS b FROM x GROUP BY run), z AS (SELECT min(b) AS b FROM y) SELECT round(b + greatest(1e-6, 0.02 * abs(b)), 8) AS target FROM z")
def target_selection(spark, sf):
    best = iterations(spark, sf).groupBy(*RW).agg(F.min("loss").alias("b")).groupBy("run").agg(F.median("b").alias("b")).agg(F.min("b").alias("b"))
    return best.select(r(F.col("b") + F.greatest(F.lit(1e-6), 0.02 * F.abs("b")), 8).alias("target"))


@query(f"WITH {_TTT}, {_IQR}, o AS (SELECT * FROM i WHERE n >= 3), k AS (SELECT *, row_number() OVER (ORDER BY med, run) AS rank, lead(lo) OVER (ORDER BY med, run) AS nl FROM o) SELECT run AS best, round(med, 4) AS med, CASE WHEN hi < nl THEN 'SEPARABLE' ELSE 'NOT SEPARABLE' END AS verdict FROM k WHERE rank = 1")
def select_best(spark, sf):
    w = Window.orderBy("med", "run")  # a row per mode
    k = _iqr(spark, sf).where("n >= 3").withColumn("rank", F.row_number().over(w)).withColumn("nl", F.lead("lo").over(w)).where("rank = 1")
    return k.select(F.col("run").alias("best"), r("med", 4).alias("med"), F.when(F.col("hi") < F.col("nl"), "SEPARABLE").otherwise("NOT SEPARABLE").alias("verdict"))


@query(f"WITH {ITERATIONS}, a AS (SELECT run, worker, min(wcss) AS w, sum(iter_time_s) AS t FROM m GROUP BY run, worker), b AS (SELECT *, min(w) OVER (PARTITION BY worker) AS best FROM a) SELECT run, round(median(t), 4) AS wall, round(avg((w - best) / best * 100), 6) AS vs_best_pct FROM b GROUP BY run")
def mode_table(spark, sf):
    a = iterations(spark, sf).groupBy(*RW).agg(F.min("wcss").alias("w"), F.sum("iter_time_s").alias("t")).withColumn("best", F.min("w").over(Window.partitionBy("worker")))
    return a.groupBy("run").agg(r(F.median("t"), 4).alias("wall"), r(F.avg((F.col("w") - F.col("best")) / F.col("best") * 100)).alias("vs_best_pct"))


@query(
    f"WITH {CELLS}, {_MEANS}, b AS (SELECT *, min(wall) OVER (PARTITION BY wid) AS best FROM a), k AS (SELECT wid, min(cores) AS rec_cpus FROM b WHERE wall <= best * 1.1 GROUP BY wid) "
    "SELECT k.wid, rec_cpus, CAST(ceil(greatest(p95 * 1.25, peak * 1.10) / 64) * 64 AS BIGINT) AS rec_mem, reps FROM k JOIN a ON a.wid = k.wid AND a.cores = k.rec_cpus"
)
def rightsize_labels(spark, sf):
    a = cells(spark, sf).groupBy("wid", "cores").agg(F.avg("wall").alias("wall"), F.percentile("rss", 0.95).alias("p95"), F.max("rss").alias("peak"), F.count("*").alias("reps"))
    k = M.knee(a, "wall", "cores", ["wid"], 0.1).select(F.col("wid").alias("kw"), F.col("knee").alias("rec_cpus"))
    return a.join(k, (F.col("wid") == F.col("kw")) & (F.col("cores") == F.col("rec_cpus"))).select("wid", "rec_cpus", scalars.recommended_memory(F.col("p95"), F.col("peak")).alias("rec_mem"), "reps")


@query(
    f"WITH {ITERATIONS}, t AS (SELECT *, row_number() {_W} AS i, lag(weight_norm) {_W} AS p FROM m), g AS (SELECT run, worker, bool_and(iteration = i) AS contiguous, coalesce(bool_or(abs(weight_norm - p) > 1e-6), false) AS moving, count(*) AS n FROM t GROUP BY run, worker) "
    "SELECT run, worker, CASE WHEN NOT contiguous THEN 'FAIL' WHEN NOT moving THEN 'FAIL' WHEN n < 5 THEN 'WARN' ELSE 'OK' END AS gate FROM g"
)
def metrics_gate(spark, sf):
    w = Window.partitionBy(*RW).orderBy("iteration")
    t = iterations(spark, sf).withColumn("i", F.row_number().over(w)).withColumn("p", F.lag("weight_norm").over(w))
    g = t.groupBy(*RW).agg(F.bool_and(F.col("iteration") == F.col("i")).alias("c"), F.coalesce(F.bool_or(F.abs(F.col("weight_norm") - F.col("p")) > 1e-6), F.lit(False)).alias("v"), F.count("*").alias("n"))
    return g.select(*RW, F.when(~F.col("c") | ~F.col("v"), "FAIL").when(F.col("n") < 5, "WARN").otherwise("OK").alias("gate"))


@query(f"WITH {ITERATIONS}, a AS (SELECT run, sum(CASE WHEN worker = 0 THEN wcss END) AS x, sum(CASE WHEN worker = 1 THEN wcss END) AS y FROM m GROUP BY run) SELECT run, round(abs(x - y) / greatest(abs(y), 1e-9), 6) AS delta, CASE WHEN abs(x - y) / greatest(abs(y), 1e-9) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM a")
def parity_check(spark, sf):
    a = iterations(spark, sf).groupBy("run").agg(F.sum(F.when(F.col("worker") == 0, F.col("wcss"))).alias("x"), F.sum(F.when(F.col("worker") == 1, F.col("wcss"))).alias("y"))
    d = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("y"), F.lit(1e-9))
    return a.select("run", r(d).alias("delta"), scalars.verdict(d, 0.01).alias("status"))


@query(f"WITH {ITERATIONS}, a AS (SELECT run, worker, sum(iter_time_s) AS t, sum(sync_time_s) AS s FROM m GROUP BY run, worker), b AS (SELECT run, max(t) AS multi, avg(s / t) * 100 AS pct, sum(t) AS single FROM a GROUP BY run) SELECT run, round(multi, 4) AS multi_s, round(single / multi, 6) AS speedup, round(pct, 4) AS sync_pct FROM b")
def sync_overhead(spark, sf):
    a = iterations(spark, sf).groupBy(*RW).agg(F.sum("iter_time_s").alias("t"), F.sum("sync_time_s").alias("s"))
    b = a.groupBy("run").agg(F.max("t").alias("multi"), (F.avg(F.col("s") / F.col("t")) * 100).alias("pct"), F.sum("t").alias("single"))
    return b.select("run", r("multi", 4).alias("multi_s"), r(F.try_divide("single", "multi")).alias("speedup"), r("pct", 4).alias("sync_pct"))


@query(f"WITH {CELLS} SELECT wid, cores, round(avg(rss), 4) AS mean_rss, max(rss) AS peak, list_sort(list(rss))[1 + CAST(round_even(0.95 * (count(*) - 1), 0) AS INT)] AS p95, min(rss) AS low FROM c GROUP BY wid, cores")
def sample_summary(spark, sf):
    a = cells(spark, sf).groupBy("wid", "cores").agg(r(F.avg("rss"), 4).alias("mean_rss"), F.max("rss").alias("peak"), F.min("rss").alias("low"))
    p95 = ranks.at_ranks(cells(spark, sf), ["wid", "cores"], "rss", {"p95": ranks.nearest(95)})
    return a.join(p95, ["wid", "cores"]).select("wid", "cores", "mean_rss", "peak", "p95", "low")


@query(f"WITH {CELLS}, a AS (SELECT wid, cores, avg(wall) AS w, avg(rss) AS m FROM c GROUP BY wid, cores), b AS (SELECT wid, min(m) AS m0 FROM a GROUP BY wid) SELECT a.wid, cores, round(w, 4) AS wall, round(m / m0, 6) AS mem_response FROM a JOIN b ON a.wid = b.wid")
def holdout_means(spark, sf):
    a = cells(spark, sf).groupBy("wid", "cores").agg(F.avg("wall").alias("w"), F.avg("rss").alias("m"))
    return a.select("wid", "cores", r("w", 4).alias("wall"), r(F.col("m") / F.min("m").over(Window.partitionBy("wid"))).alias("mem_response"))


@query(f"WITH {CELLS}, x AS (SELECT wid, cores, count(DISTINCT driver) AS done, count(*) FILTER (wall > 150000) AS timed_out FROM c GROUP BY wid, cores) SELECT *, timed_out >= 2 AS skip FROM x")
def resume_bookkeeping(spark, sf):
    x = cells(spark, sf).groupBy("wid", "cores").agg(F.countDistinct("driver").alias("done"), F.count_if(F.col("wall") > 150000).alias("timed_out"))
    return x.withColumn("skip", F.col("timed_out") >= 2)


_LEVELS = {"dims": (8, 16, 32), "k": (4, 8, 16), "cores": (1, 2, 4, 8)}
_DESIGN = M.seeded_design(_LEVELS, 12, seed=7)


def _design_sql() -> str:
    """The greedy choice in SQL; where it begins and the order of runs are the seed's draws, given to both."""
    names = list(_LEVELS)
    value = lambda f, t: f"{t}.{f}i / {len(_LEVELS[f]) - 1}.0"
    far = " + ".join(f"pow({value(f, 'p')} - {value(f, 'q')}, 2)" for f in names)
    room = " AND ".join(f"(SELECT count(*) FROM g q WHERE list_contains(s.chosen, q.i) AND q.{f} = p.{f}) < {-(-12 // len(_LEVELS[f])) + 1}" for f in names)
    levels = " ".join(f", (SELECT unnest({list(v)}) AS {f}, unnest(range({len(v)})) AS {f}i)" for f, v in _LEVELS.items()).lstrip(", ")
    index = " + ".join(f"{f}i * {int(np.prod([len(_LEVELS[x]) for x in names[k + 1 :]]))}" for k, f in enumerate(names))
    return (
        f"WITH RECURSIVE g AS (SELECT *, {index} AS i FROM {levels}), s AS (SELECT 1 AS n, [CAST({_DESIGN.start} AS BIGINT)] AS chosen UNION ALL "
        f"SELECT n + 1, list_append(chosen, (SELECT CAST(p.i AS BIGINT) FROM g p WHERE NOT list_contains(s.chosen, p.i) AND {room} "
        f"ORDER BY (SELECT round(min({far}), 9) FROM g q WHERE list_contains(s.chosen, q.i)) DESC, p.i LIMIT 1)) FROM s WHERE n < 12), "
        f"c AS (SELECT chosen FROM s WHERE n = 12), o AS (SELECT unnest({_DESIGN.order}) AS at, unnest(range(12)) AS pick) "
        "SELECT CAST(pick AS INT) AS pick, dims, k, cores FROM o, c, g WHERE g.i = c.chosen[o.at + 1]"
    )


@query(_design_sql())
def design_maximin(spark: SparkSession, sf: str) -> DataFrame:
    """A spread-out design of 12 cells from a small grid, from a seeded start and in a seeded order."""
    return spark.createDataFrame([(n, *cell) for n, cell in enumerate(_DESIGN.cells)], "pick int, dims int, k int, cores int")


@query("SELECT o_orderkey AS run_id, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS position FROM orders WHERE o_orderkey % 100 = 0")
def run_order(spark, sf):
    """Runs in an order that a seed gives, alike on every cluster."""
    runs = table(spark, sf, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("run_id"))
    return M.seeded_order(runs, "run_id", 42)


_REF = "t AS (SELECT *, lag(loss) OVER (PARTITION BY run ORDER BY iteration) AS p, first_value(grad_norm) OVER (PARTITION BY run ORDER BY iteration) AS g0 FROM m WHERE worker = 0), v AS (SELECT run, iteration, CASE WHEN count(*) > 1 THEN max(iter_time_s) - min(iter_time_s) ELSE 0.0 END AS var FROM m GROUP BY run, iteration), x AS (SELECT t.run, iteration, spark_time_s, sync_time_s, iter_time_s, loss, CASE WHEN iter_time_s > 0 THEN round(sync_time_s / iter_time_s * 100, 4) ELSE 0.0 END AS sync_pct, CASE WHEN iter_time_s > 0 THEN round(spark_time_s / iter_time_s, 4) ELSE 0.0 END AS fraction, CASE WHEN p > 0 THEN round((p - loss) / p, 6) ELSE 0.0 END AS drop, round(grad_norm / CASE WHEN g0 > 0 THEN g0 ELSE 1.0 END, 6) AS decay, round(var, 6) AS var FROM t JOIN v USING (run, iteration))"


@query(f"WITH {ITERATIONS}, {_REF} SELECT run, iteration, sync_pct, fraction, CASE WHEN fraction > 0.6 THEN 'compute' WHEN fraction < 0.4 THEN 'sync' ELSE 'balanced' END AS bottleneck, drop AS loss_drop_rate, decay AS grad_norm_decay, var AS rank_variance_s FROM x")
def logreg_epoch_detail(spark, sf):
    return M.epoch_detail(iterations(spark, sf)).select("run", "iteration", "sync_pct", "fraction", "bottleneck", "loss_drop_rate", "grad_norm_decay", "rank_variance_s")


@query(
    f"WITH {ITERATIONS}, {_REF}, c AS (SELECT run, count(*) AS iterations, round(avg(spark_time_s), 6) AS spark_mean, max(spark_time_s) AS spark_max, round(stddev_pop(sync_time_s), 6) AS sync_std, round(avg(sync_pct), 4) AS pct_mean, "
    "arg_max(loss, iteration) AS final_loss, max(var) AS variance_max, count(*) FILTER (fraction > 0.6) AS a, count(*) FILTER (fraction < 0.4) AS b, count(*) FILTER (fraction BETWEEN 0.4 AND 0.6) AS d FROM x GROUP BY run) "
    "SELECT run, iterations, spark_mean, spark_max, sync_std, pct_mean, round(final_loss, 8) AS final_loss, variance_max, CASE WHEN a >= b AND a >= d THEN 'compute' WHEN b >= d THEN 'sync' ELSE 'balanced' END AS bottleneck_mode FROM c"
)
def logreg_epoch_summary(spark, sf):
    e = M.epoch_detail(iterations(spark, sf))
    c = e.groupBy("run").agg(
        F.count("*").alias("iterations"), r(F.avg("spark_time_s")).alias("spark_mean"), F.max("spark_time_s").alias("spark_max"), r(F.stddev_pop("sync_time_s")).alias("sync_std"), r(F.avg("sync_pct"), 4).alias("pct_mean"),
        r(F.max_by("loss", "iteration"), 8).alias("final_loss"), F.max("rank_variance_s").alias("variance_max"), *(F.count_if(F.col("bottleneck") == k).alias(k) for k in ("compute", "sync", "balanced")),
    )
    most = F.when((F.col("compute") >= F.col("sync")) & (F.col("compute") >= F.col("balanced")), "compute").when(F.col("sync") >= F.col("balanced"), "sync").otherwise("balanced")
    return c.withColumn("bottleneck_mode", most).drop("compute", "sync", "balanced")


@query(
    f"WITH {_TTT}, tg AS (SELECT DISTINCT run FROM m), f AS (SELECT run, median(ttt) AS med, count(*) AS reached FROM tt WHERE worker > 0 GROUP BY run), b AS (SELECT run, median(ttt) AS base, count(*) AS base_reached FROM tt WHERE worker = 0 GROUP BY run) "
    "SELECT tg.run, coalesce(reached, 0) AS reached, round(med, 4) AS median_ttt_s, coalesce(base_reached, 0) AS base_reached, round(base, 4) AS base_median_ttt_s, round(base / nullif(med, 0), 6) AS speedup FROM tg LEFT JOIN f USING (run) LEFT JOIN b USING (run)"
)
def logreg_ttt_speedup(spark, sf):
    """Median time to the target of a mode's runs against the baseline's (here worker 0); null where one never got there."""
    t = _ttt(spark, sf)
    return M.ttt_speedup(iterations(spark, sf).select("run").distinct(), t.where("worker > 0"), t.where("worker = 0"), ["run"], "ttt").select(
        "run", "reached", r("median_ttt_s", 4).alias("median_ttt_s"), "base_reached", r("base_median_ttt_s", 4).alias("base_median_ttt_s"), r("speedup").alias("speedup")
    )


@query("SELECT CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS peak, CAST(0 AS BIGINT) AS n")
def empty_aggregates(spark, sf):
    """Mean and maximum of nothing are null, not 0 and no error."""
    return table(spark, sf, "events").where("value < -1e18").agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count("*").alias("n"))


@query(f"WITH {ITERATIONS}, s AS (SELECT run, CAST(floor(iteration / 50) AS BIGINT) AS win, max(iter_time_s) AS busiest, count(*) AS n FROM m GROUP BY ALL) SELECT run, win, round(busiest, 4) AS busiest, n, busiest < 150 AS stalled FROM s")
def stall_windows(spark, sf):
    s = iterations(spark, sf).groupBy("run", F.floor(F.col("iteration") / 50).alias("win")).agg(F.max("iter_time_s").alias("busiest"), F.count("*").alias("n"))
    return s.select("run", "win", r("busiest", 4).alias("busiest"), "n", (F.col("busiest") < 150).alias("stalled"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(avg(value), 10) AS mean, max(value) AS peak FROM events GROUP BY ALL")
def sampler_tumbling(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), r(F.avg("value"), 10).alias("mean"), F.max("value").alias("peak"))
    return e.select("event_type", F.col("w.start").alias("start"), "n", "mean", "peak")


@query(
    "WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) >= 300000000 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid"
)
def stall_sessions(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))
    return e.select("user_id", F.col("w.start").alias("start"), "n", "total")


# -- remaining scalars ---------------------------------------------------------------------------------------------------
@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 200")
def sample_by_hash(spark, sf):
    """A seedless sample that is the same everywhere: the rows with the smallest hashes."""
    return table(spark, sf, "events").select("event_id").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id").limit(200)


@query("SELECT event_id, round((list_position([1, 2, 4, 8], [1, 2, 4, 8][1 + event_id % 4]) - 1) / 3.0, 6) AS level, least(greatest(floor((event_id % 5 - 2 + 1) / 2.0), 0), 1) AS label, round_even(value, 1) AS half_even FROM events")
def normalised_scalars(spark, sf):
    levels = F.array(*[F.lit(k) for k in (1, 2, 4, 8)])
    own = F.get(levels, (F.col("event_id") % 4).cast("int"))
    y = F.col("event_id") % 5 - 2
    return table(spark, sf, "events").select(
        "event_id", r((F.array_position(levels, own) - 1) / 3.0).alias("level"), F.least(F.greatest(F.floor((y + 1) / 2.0), F.lit(0)), F.lit(1)).cast("double").alias("label"), F.bround("value", 1).alias("half_even")
    )


@query(f"WITH {ITERATIONS} SELECT run, worker, round(sum(iter_time_s) / greatest(sum(CASE WHEN staleness = 0 THEN sync_time_s ELSE 0 END), 1e-4), 6) AS ratio, count(*) FILTER (exit_code = 0) AS good FROM m GROUP BY run, worker")
def guarded_ratio(spark, sf):
    low = F.sum(F.when(F.col("staleness") == 0, F.col("sync_time_s")).otherwise(0.0))
    return iterations(spark, sf).groupBy(*RW).agg(r(F.sum("iter_time_s") / F.greatest(low, F.lit(1e-4))).alias("ratio"), F.count_if(F.col("exit_code") == 0).alias("good"))


@query(
    "SELECT event_id, round((n - 1) * (2.7 + 0.024 * mb / (n - 1)) + 1.0, 6) AS by_size, round((n - 1) * (2.7 + 0.024 * mb / (n - 1) + 0.3 * (c - 4)) + 1.0, 6) AS by_size_and_cores, "
    "round((n - 1) * (1.6 + 0.05 * greatest(0, c - 4)) + 1.0, 6) AS by_cores FROM (SELECT event_id, user_id % 5 + 2 AS n, value AS mb, user_id % 8 + 1 AS c FROM events)"
)
def memory_estimates(spark, sf):
    """GB that a run of n - 1 workers is taken to need, by three published rules."""
    n, mb, c = F.col("user_id") % 5 + 1, F.col("value"), F.col("user_id") % 8 + 1
    return table(spark, sf, "events").select(
        "event_id", r(n * (2.7 + 0.024 * mb / n) + 1.0).alias("by_size"), r(n * (2.7 + 0.024 * mb / n + 0.3 * (c - 4)) + 1.0).alias("by_size_and_cores"),
        r(n * (1.6 + 0.05 * F.greatest(F.lit(0), c - 4)) + 1.0).alias("by_cores"),
    )


@query(f"WITH {ITERATIONS}, a AS (SELECT run, iteration, avg(loss) AS l FROM m GROUP BY run, iteration) SELECT run, list(round(l, 6) ORDER BY iteration)[1] AS s1, list(round(l, 6) ORDER BY iteration)[2] AS s2, list(round(l, 6) ORDER BY iteration)[5] AS s5 FROM a GROUP BY run")
def loss_series(spark, sf):
    a = iterations(spark, sf).groupBy("run", "iteration").agg(r(F.avg("loss")).alias("l"))
    series = F.transform(F.array_sort(F.collect_list(F.struct("iteration", "l"))), lambda x: x["l"])
    return a.where("iteration <= 5").groupBy("run").agg(series.alias("s")).select("run", *(F.get("s", k - 1).alias(f"s{k}") for k in (1, 2, 5)))
