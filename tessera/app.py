"""Runs a workload over a file: ``python -m tessera.app --app kmeans --input points.csv --workers 4``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session, staging
from tessera.operators import kmeans, logreg, sharding, sync_modes, wordcount
from tessera.recorders import Recorder, Stopwatch
from tessera.sources import points as point_files

APPS = ("wordcount", "kmeans", "logreg")


def _point_columns(lines: DataFrame, width: int, shards: int) -> tuple[DataFrame, list[str]]:
    names = [f"f{i}" for i in range(width)]
    numbered = sharding.line_numbers(lines).withColumn("shard", F.col("line") % shards)
    parsed = numbered.select("shard", F.transform(point_files.tokens(F.col("value")), lambda t: t.try_cast("double")).alias("v"))
    parsed = parsed.where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull()))
    return parsed.select("shard", *(F.element_at("v", i + 1).alias(n) for i, n in enumerate(names))), names


def run(
    spark: SparkSession, app: str, path: str, *, workers: int | None = None, sync_mode: str | None = None, top: int = 20, kmeans_k: int = 3, kmeans_iter: int = 20, tol: float = 1e-4,
    local_epochs: int = 5, seed: int = 42, gossip: bool = False, gossip_threshold: float = 1e-3, gossip_max_rounds: int = 10, gossip_fanout: int | None = None, global_seed: bool = False,
    reassign: bool = False, logreg_iter: int = 10, logreg_reg_param: float = 0.01, logreg_features: int = 10, loss_tol: float = 1e-4, compare: bool = False, results_dir: str | None = None,
) -> dict:
    """The result of a workload over the lines of a file, line i in shard i mod ``workers``, with times."""
    if app not in APPS:
        raise ValueError(f"unknown app {app!r}; known: {', '.join(APPS)}")
    mode, n, watch = sync_modes.normalise(sync_mode), sharding.resolve_workers(workers), Stopwatch()
    watch.start("total")
    lines = spark.read.text(path)
    out: dict = {"app": app, "sync_mode": mode, "workers": n}
    recorder: Recorder | None = None
    if app == "wordcount":
        sharded = sharding.line_numbers(lines)
        counts = wordcount.merge(wordcount.shard_counts(sharded, F.col("line") % n, "value"))
        out["top"] = [(r["word"], r["n"]) for r in wordcount.top(counts, top).collect()]
        if compare:
            out["baseline_top"] = [(r["word"], r["n"]) for r in wordcount.top(wordcount.word_count(lines, "value"), top).collect()]
    elif app == "kmeans":
        pts, names = _point_columns(lines, point_files.width_of(lines), n)
        pts = pts.cache()
        try:
            start = kmeans.mllib_baseline(pts, names, kmeans_k, fraction=0.05, seed=seed)[0] if global_seed else kmeans.initial_centres(pts, names, kmeans_k, seed)
            r = kmeans.fit(pts, names, start, sync_modes.NONE if gossip else mode, rounds=kmeans_iter, local_epochs=local_epochs, tol=tol, fanout=gossip_fanout, seed=seed)
            centres, wcss = r.centres, r.wcss
            if gossip:
                stats = kmeans.shard_stats(pts, names, r.shards)
                merged = kmeans.gossip_merge(
                    {s: (m, stats[s].wcss, stats[s].rows) for s, m in r.shards.items()}, threshold=gossip_threshold, max_rounds=gossip_max_rounds, fanout=gossip_fanout or 2, seed=seed,
                    reference=start if global_seed else None,
                )
                centres, wcss = merged["centres"], kmeans.global_stats(pts, names, merged["centres"]).wcss
            if reassign:
                centres, _ = kmeans.reassign(pts, names, centres)
                wcss = kmeans.global_stats(pts, names, centres).wcss
            out |= {"centres": centres.tolist(), "wcss": wcss, "rows": r.rows, "rounds": r.rounds, "converged": r.converged}
            if compare:
                out["baseline_wcss"] = kmeans.mllib_baseline(pts, names, kmeans_k, max_iter=kmeans_iter, seed=seed)[1]
        finally:
            pts.unpersist()
        recorder = Recorder.kmeans()
        for e in r.log:
            recorder.record(iteration=e.get("round", e.get("version")), centroid_shift=e.get("shift"), global_wcss=e.get("wcss", e.get("local_wcss")))
    else:
        pts, names = _point_columns(lines, logreg_features + 1, n)
        pts = pts.withColumn("label", F.col(names[-1]).cast("int")).drop(names[-1]).cache()
        try:
            r = logreg.fit(pts, names[:-1], mode=mode, rounds=logreg_iter, local_steps=local_epochs, reg=logreg_reg_param, tol=loss_tol, fanout=gossip_fanout)
            out |= {"weights": r.weights.tolist(), "intercept": r.intercept, "loss": r.loss, "accuracy": r.accuracy, "rows": r.rows, "rounds": r.rounds, "converged": r.converged}
            if compare:
                m = logreg.mllib_baseline(pts, names[:-1], max_iter=logreg_iter, reg=logreg_reg_param)
                out["baseline_accuracy"] = m.summary.accuracy
        finally:
            pts.unpersist()
        recorder = Recorder.logreg()
        for e in r.log:
            recorder.record(epoch=e.get("round", e.get("epoch", e.get("version"))), global_loss=e.get("global_loss"))
    out["total_s"] = watch.stop("total")
    if results_dir and recorder is not None and recorder.rows:
        recorder.write(spark, f"{results_dir}/{app}_{mode}_iterations")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m tessera.app", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("--app", default="wordcount", choices=APPS)
    p.add_argument("--input", required=True)
    p.add_argument("--workers", type=int)
    p.add_argument("--cores", type=int)
    p.add_argument("--sync-mode", default=sync_modes.DEFAULT)
    for name, kind, default in (
        ("kmeans-k", int, 3), ("kmeans-iter", int, 20), ("logreg-iter", int, 10), ("logreg-reg-param", float, 0.01), ("logreg-features", int, 10),
        ("gossip-threshold", float, 1e-3), ("gossip-max-rounds", int, 10), ("gossip-fanout", int, None), ("results-dir", str, None),
    ):
        p.add_argument(f"--{name}", type=kind, default=default)
    for flag in ("gossip", "global-seed", "reassign", "compare"):
        p.add_argument(f"--{flag}", action="store_true")
    args = vars(p.parse_args(argv))
    spark = session.build_session(cores=args.pop("cores"))
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print(json.dumps(run(spark, args.pop("app"), args.pop("input"), **args), indent=1))
    finally:
        staging.clean_up(spark)


if __name__ == "__main__":
    main()
