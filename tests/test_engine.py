"""Sessions, staging, streams, sinks, generators, ranks, and whole fits against numpy."""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import recorders, session, staging
from tessera.operators import kernels, kmeans, logreg, metrics, ranks, sharding, sync_modes
from tessera.plans.tables import POINT_FEATURES, scaled
from tessera.sources import generators
from tessera.sources import metrics as tables
from tessera.sources import points as point_files
from tessera.sources import text as logs
from tessera.streaming import streams


class TestSession:
    def test_submitted_settings_win(self):
        given = {"spark.master": "yarn", "spark.driver.memory": "9g", "spark.sql.shuffle.partitions": "4000"}
        got = session.settings({"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC"}, {"spark.driver.memory": "1g", "x": "y"}, given)
        assert got == {"spark.sql.session.timeZone": "UTC", "x": "y"}

    def test_nothing_submitted(self, monkeypatch):
        monkeypatch.delenv("PYSPARK_GATEWAY_PORT", raising=False)
        assert session.submitted() is None


class _Cluster:
    """A session off a local master."""

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://host:7077", "app"

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


class TestStaging:
    def test_a_cluster_needs_a_shared_folder(self):
        with pytest.raises(RuntimeError):
            staging.shared_folder(_Cluster(None))
        assert staging.shared_folder(_Cluster("hdfs:/x/")).startswith("hdfs:/x/tessera/app/")

    def test_staged_tables_can_be_deleted(self, spark):
        df = staging.stage(spark.range(5))
        path = df._staged_at
        assert df.count() == 5 and os.path.isdir(path)
        staging.unstage(df)
        staging.unstage(spark.range(1))
        assert not os.path.exists(path)


class TestStreams:
    def test_no_result_lies_in_the_driver(self, spark, tmp_path):
        spark.range(20).select((F.col("id") % 3).alias("k"), "id").repartition(4).write.parquet(f"{tmp_path}/in")
        stream = streams.read_stream(spark, f"{tmp_path}/in", files_per_batch=1)
        plain = streams.drain(stream, "append")
        assert sorted(r.id for r in plain.collect()) == list(range(20)) and plain.inputFiles()
        counts = streams.drain(streams.read_stream(spark, f"{tmp_path}/in", files_per_batch=1).groupBy("k").count(), "complete")
        assert {(r.k, r["count"]) for r in counts.collect()} == {(0, 7), (1, 7), (2, 6)} and counts.inputFiles()


class TestRanks:
    def test_against_sorting(self, spark):
        r = np.random.default_rng(2)
        rows = [(f"g{int(g)}" if g < 4 else None, float(v)) for g, v in zip(r.integers(0, 5, 3000), np.round(r.normal(size=3000), 1), strict=True)] + [("one", 5.0), ("empty", None)]
        df = spark.createDataFrame(rows, "g string, v double")
        asked = {"p95": ranks.nearest(95), "lo": ranks.LOWER_QUARTILE, "first": lambda n: F.lit(0), "last": lambda n: n - 1}
        for ranges in (2, 64):
            got = {x.g: x for x in ranks.at_ranks(df, ["g"], "v", asked, ranges).collect()}
            assert set(got) == {"g0", "g1", "g2", "g3", None, "one"}
            for g, x in got.items():
                v = sorted(b for a, b in rows if a == g and b is not None)
                assert (x.n, x.p95, x.lo, x.first, x.last) == (len(v), v[round(0.95 * (len(v) - 1))], v[int(0.25 * (len(v) - 1))], v[0], v[-1])
        med = {x.g: x.m for x in ranks.medians(df, ["g"], "v", "m").collect()}
        assert all(m == pytest.approx(np.median([b for a, b in rows if a == g and b is not None])) for g, m in med.items())
        assert ranks.at_ranks(df.where("false"), ["g"], "v", asked).count() == 0


class TestSinksAndSources:
    def test_tables_are_upgraded_or_moved_aside(self, spark, tmp_path):
        path, schema = f"{tmp_path}/t", tables.ddl("a int, b int, c string")
        assert tables.prepare_table(spark, path, schema) == "absent"
        spark.createDataFrame([(1, 2)], "a int, b int").write.option("header", True).csv(path)
        assert tables.prepare_table(spark, path, schema) == "upgraded"
        assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "2", None)]
        assert tables.prepare_table(spark, path, schema) == "same"
        assert tables.prepare_table(spark, path, tables.ddl("x int")) == "rotated"
        assert not os.path.exists(path) and any(".old-" in n for n in os.listdir(tmp_path))

    def test_shards_are_written_and_cleaned(self, spark, tmp_path):
        path = f"{tmp_path}/shards"
        sharding.write_shards(spark.range(10).withColumn("shard", F.col("id") % 3), path)
        assert sorted(n for n in os.listdir(path) if n.startswith("shard=")) == ["shard=0", "shard=1", "shard=2"] and spark.read.parquet(path).count() == 10
        sharding.clean_shards(spark, path)
        sharding.clean_shards(spark, path)
        assert not os.path.exists(path)
        assert (sharding.cores_each(22, 4), sharding.cores_each(22, 4, False), sharding.cores_each(1, 4, False)) == (6, 5, 1)

    def test_generators(self, spark):
        df = generators.classification(spark, 4000, 10, seed=3)
        assert df.columns == [f"f{i}" for i in range(10)] + ["label"] and abs(df.agg(F.avg("label")).first()[0] - 0.5) < 0.05
        made = generators.published(spark, 0.01)
        assert made["logreg"].count() == made["kmeans"].count() == 5400 and len(made["kmeans"].columns) == 8 and made["wordcount"].count() == 666
        assert generators.classification(spark, 50, seed=3).collect() == generators.classification(spark, 50, seed=3).collect()

    def test_standardised_reader_and_head(self, spark, tmp_path):
        path = f"{tmp_path}/p.csv"
        with open(path, "w") as f:
            f.write("f0,f1,label\n" + "\n".join(f"{k},{2 * k + 1},{int(k > 4)}" for k in range(10)))
        points, by = point_files.read_standardised(spark, path, 2)
        x = np.arange(10)
        assert by["f0"] == pytest.approx((x.mean(), x.std())) and points.agg(F.round(F.avg("f1"), 9), F.round(F.stddev_pop("f1"), 9)).first() == (0.0, 1.0)
        assert point_files.accuracy_of_head(points, ["f0", "f1"], [1.0, 0.0], 0.0, 10) == 1.0
        assert point_files.template_info(spark.read.text(path)) == {"header": True, "label_name": "label", "label_float": False}
        assert logs.file_digest(spark, path).first().digest and logs.read_head(spark, path, 2).count() == 2 and logs.read_whole(spark, path).first().size > 20

    def test_logs_of_a_run(self, spark, sf_dir, tmp_path):
        pts = scaled(spark, sf_dir).limit(400).cache()
        for mode in ("fedavg_mpi", "async", "hybrid", "none"):
            r = logreg.fit(pts, POINT_FEATURES, mode=mode, rounds=2, local_steps=2)
            recorders.write_run(spark, r, str(tmp_path), f"r_{mode}", mode, 4, reg=0.01, features=4)
            n = len({w["worker_id"] for w in r.workers})
            assert len(r.workers) == 2 * n
        rounds = spark.read.option("header", True).csv(f"{tmp_path}/iter_metrics")
        assert rounds.groupBy("run_id").count().count() == 4 and rounds.where("row_count is null").count() == 0
        assert spark.read.option("header", True).csv(f"{tmp_path}/staleness").count() == 8 and spark.read.option("header", True).csv(f"{tmp_path}/scalars").count() == 2
        assert {r.mode for r in tables.read_history(spark, f"{tmp_path}/runs").collect()} == {"fedavg_mpi", "async", "hybrid", "none"}
        pts.unpersist()

    def test_json(self, spark):
        df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
        text = tables.encode(df, ["k", "s"])
        assert json.loads(text.first().record) == {"k": 1, "s": "a"}
        assert [tuple(r) for r in tables.decode(text, df.schema).collect()] == [(1, "a"), (2, None)]


def _numbers(spark, sf_dir):
    rows = scaled(spark, sf_dir).select("shard", *POINT_FEATURES, "label").collect()
    return np.array([[r[f] for f in POINT_FEATURES] for r in rows]), np.array([r["shard"] for r in rows]), np.array([float(r["label"]) for r in rows])


class TestFitsAgainstNumpy:
    START = np.array([[0.2, 0.2, 0.2, 0.2], [0.5, 0.5, 0.5, 0.5], [0.9, 0.8, 0.7, 0.9]])

    @staticmethod
    def lloyd(x, c):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        return np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])

    @staticmethod
    def align(a, b):
        return np.array(min((np.array(p) for p in itertools.permutations(b)), key=lambda p: np.linalg.norm(a - p, axis=1).sum()))

    @staticmethod
    def wcss(x, c):
        return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()

    @pytest.mark.parametrize("mode", sorted(sync_modes.MODES))
    def test_kmeans(self, spark, sf_dir, mode):
        x, shard, _ = _numbers(spark, sf_dir)
        pts = scaled(spark, sf_dir).cache()
        got = kmeans.fit(pts, POINT_FEATURES, self.START, mode, rounds=2, local_epochs=2, tol=0.0)
        pts.unpersist()
        parts = [x[shard == s] for s in range(4)]
        n = np.array([len(p) for p in parts], float)
        local = lambda s, c: self.lloyd(parts[s], self.lloyd(parts[s], c))
        mean = lambda ms, ws: sum(m * w for m, w in zip(ms, ws, strict=True)) / sum(ws)
        models = [self.START] * 4
        if mode == sync_modes.ALLREDUCE:
            want = self.lloyd(x, self.lloyd(x, self.START))
        elif mode == sync_modes.ASYNC:
            want, version, base = self.START, 0, [0] * 4
            for s in [0, 1, 2, 3] * 2:
                a = 1.0 if version == 0 else 0.5 / (1 + max(0, version - base[s]))
                want = (1 - a) * want + a * local(s, models[s])
                version += 1
                base[s], models[s] = version, want
        else:
            for _ in range(2):
                out = [local(s, models[s]) for s in range(4)]
                if mode == sync_modes.NONE:
                    models = out
                elif mode == sync_modes.GOSSIP:
                    models = [mean([out[s], *(self.align(out[s], out[p]) for p in ((s - 1) % 4, (s + 1) % 4))], [n[s], n[(s - 1) % 4], n[(s + 1) % 4]]) for s in range(4)]
                elif mode == sync_modes.HYBRID:
                    models = [mean(out, n)] * 4
                else:
                    models = [mean([self.align(out[0], o) for o in out], n)] * 4
            want = mean([self.align(models[0], m) for m in models], n)
        assert np.allclose(got.centres, want, atol=1e-9) and got.wcss == pytest.approx(self.wcss(x, got.centres))
        if mode == sync_modes.HYBRID:
            assert got.log[-1]["scalar"] == pytest.approx(got.wcss)

    def test_many_models_are_joined(self, spark, sf_dir, monkeypatch):
        from tessera.operators import models

        pts = scaled(spark, sf_dir)
        at = {s: self.START + s / 10 for s in range(4)}
        sent = kmeans.shard_stats(pts, POINT_FEATURES, at)
        monkeypatch.setattr(models, "LITERAL_NUMBERS", 5)
        dealt = kmeans.shard_stats(pts, POINT_FEATURES, at)
        assert all(np.allclose(sent[s].sums, dealt[s].sums) and sent[s].wcss == pytest.approx(dealt[s].wcss) for s in at)

    def test_gossip_merge_drift(self):
        r = np.random.default_rng(3)
        states = {s: (r.normal(size=(3, 2)) + s, 1.0, 10 + s) for s in range(4)}
        got = kmeans.gossip_merge(states, max_rounds=1, seed=5)
        rng = __import__("random").Random(5)
        now, mass = {s: c.copy() for s, (c, _, _) in states.items()}, {s: float(n) for s, (_, _, n) in states.items()}
        order = list(now)
        rng.shuffle(order)
        for s in order:
            for p in rng.sample([o for o in order if o != s], 2):
                now[s] = (now[s] * mass[s] + self.align(now[s], now[p]) * mass[p]) / (mass[s] + mass[p])
                mass[s] += mass[p]
        first = states[0][0]
        drift = max(np.linalg.norm(self.align(first, now[s]) - self.align(first, states[s][0]), axis=1).max() for s in now)
        assert got["log"][0]["max_drift"] == pytest.approx(drift)

    def test_logreg_reaches_the_optimum(self, spark, sf_dir):
        x, _, y = _numbers(spark, sf_dir)
        pts = scaled(spark, sf_dir).withColumn("shard", F.lit(0)).cache()
        for standardise in (False, True):
            got = logreg.fit(pts, POINT_FEATURES, mode="none", rounds=3, local_steps=60, reg=0.01, standardise=standardise)
            sd = x.std(0, ddof=1) if standardise else np.ones(4)
            a = np.column_stack([x / sd, np.ones(len(x))])
            w, pull = np.zeros(5), np.diag([0.01] * 4 + [0.0])
            for _ in range(50):
                p = 1 / (1 + np.exp(-a @ w))
                w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + pull, a.T @ (p - y) / len(y) + pull @ w)
            assert np.allclose([*(got.weights * sd), got.intercept], w, atol=2e-3)
            assert [e["evaluations"] for e in got.log[1:]] == [0, 0]
        m = logreg.mllib_baseline(pts, POINT_FEATURES, max_iter=100, reg=0.01)
        assert np.allclose(m.coefficients.toArray(), got.weights, atol=2e-3)
        pts.unpersist()

    def test_baseline_report(self, spark, sf_dir):
        pts = scaled(spark, sf_dir)
        got = logreg.baseline_report(pts, POINT_FEATURES, max_iter=50, parity_iter=2)
        assert got["error"] is None and got["iterations"] <= 2 and 0 <= got["accuracy"] <= 1
        assert logreg.baseline_report(pts.where("false"), POINT_FEATURES)["error"] and logreg.baseline_report(pts, ["none"])["error"]

    def test_kernels(self, spark, sf_dir):
        x, _, _ = _numbers(spark, sf_dir)
        got = kernels.row_stats(scaled(spark, sf_dir), POINT_FEATURES, "label", self.START, np.zeros(5))
        assert got["kmeans_wcss"][0] == pytest.approx(self.wcss(x, self.START)) and got["kmeans_counts"].sum() == len(x)


class TestDesign:
    def test_seeded_design(self):
        levels = {"a": (1, 2, 4), "b": (10, 20, 30, 40), "c": (0, 1)}
        d = metrics.seeded_design(levels, 8, 11)
        assert d == metrics.seeded_design(levels, 8, 11) and len(set(d.cells)) == len(d.cells) == 8
        for f, v in enumerate(levels.values()):
            assert all(sum(c[f] == x for c in d.cells) <= -(-8 // len(v)) + 1 for x in v)
        assert sorted(d.order) == list(range(8)) and len(metrics.seeded_design(levels, 99, 1).cells) <= 24
