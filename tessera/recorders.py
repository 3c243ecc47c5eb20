"""Iteration records, kept on the driver while a run goes on and handed over as tables."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources import metrics


class Stopwatch:
    """Named timers; stopping one that was not started is a KeyError, an unknown one has taken 0."""

    def __init__(self) -> None:
        self._began: dict[str, float] = {}
        self._taken: dict[str, float] = {}

    def start(self, name: str) -> None:
        self._began[name] = time.perf_counter()

    def stop(self, name: str) -> float:
        self._taken[name] = time.perf_counter() - self._began.pop(name)
        return self._taken[name]

    def elapsed(self, name: str) -> float:
        return self._taken.get(name, 0.0)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        self.start(name)
        try:
            yield
        finally:
            self.stop(name)


class Recorder:
    """Rows of a fixed schema; ``share`` names the part and the whole of the overhead column, in percent."""

    def __init__(self, schema: T.StructType, share: tuple[str, str] | None = None, out: str = "sync_overhead_pct"):
        self.schema, self.share, self.out = schema, share, out
        self.rows: list[dict] = []

    @classmethod
    def kmeans(cls) -> Recorder:
        return cls(metrics.KMEANS_ITERATIONS, ("sync_time_s", "iter_time_s"))

    @classmethod
    def logreg(cls) -> Recorder:
        return cls(metrics.LOGREG_EPOCHS)

    def record(self, **values) -> None:
        if self.share and self.out not in values:
            part, whole = (values.get(n) or 0.0 for n in self.share)
            values[self.out] = round(part / whole * 100, 4) if whole > 0 else 0.0
        unknown = set(values) - set(self.schema.fieldNames())
        if unknown:
            raise KeyError(f"no such columns: {sorted(unknown)}")
        self.rows.append(values)

    def series(self, column: str) -> list:
        return [r.get(column) for r in self.rows]

    def last(self, column: str, default=0.0):
        return self.rows[-1].get(column, default) if self.rows else default

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.get(n) for n in self.schema.fieldNames()) for r in self.rows], self.schema)

    def write(self, spark: SparkSession, path: str, kind: str = "csv") -> None:
        w = self.frame(spark).write.mode("overwrite")
        w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def worker_rounds(spark: SparkSession, result, run_id: str, mode: str, workers: int, reg: float = 0.0, features: int = 0) -> DataFrame:
    """Each shard's rounds of a fitted model (``Result.workers``) as merged iterations."""
    rows = [r | {"run_id": run_id, "num_workers": workers, "sync_mode": mode, "reg_param": reg, "num_features": features} for r in result.workers]
    names = metrics.MERGED_ITERATIONS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], metrics.MERGED_ITERATIONS)


def staleness_log(spark: SparkSession, result) -> DataFrame:
    """What an asynchronous fit's server took in, update by update."""
    rows = [(e["version"], e["shard"], e.get("worker_round"), e.get("rows"), e["staleness"], e["alpha"], e.get("weight_norm"), e.get("elapsed_s")) for e in result.log if "staleness" in e]
    return spark.createDataFrame(rows, metrics.STALENESS)


def scalar_rounds(spark: SparkSession, result) -> DataFrame:
    """The scalar that a hybrid fit's shards average beside their weights, round by round."""
    rows = [(e["round"], e["scalar"], e.get("elapsed_s")) for e in result.log if "scalar" in e]
    return spark.createDataFrame(rows, metrics.SCALAR_ROUNDS)


def write_run(spark: SparkSession, result, folder: str, run_id: str, mode: str, workers: int, **more) -> None:
    """Appends a fit's logs: rounds of its shards by mode and worker, staleness and scalars where the mode has them, and the run as JSON."""
    rounds = worker_rounds(spark, result, run_id, mode, workers, **more)
    metrics.append(rounds, f"{folder}/iter_metrics", metrics.MERGED_ITERATIONS, ["run_id", "sync_mode", "worker_id"])
    for frame, name in ((staleness_log(spark, result), "staleness"), (scalar_rounds(spark, result), "scalars")):
        if frame.head(1):
            metrics.write_report(frame, f"{folder}/{name}", run_id)
    run = {"run_id": run_id, "mode": mode, "workers": workers, "rounds": result.rounds, "converged": result.converged, "rows": result.rows, "loss": result.loss, "accuracy": result.accuracy}
    metrics.append_history(spark.createDataFrame([run]), f"{folder}/runs")
