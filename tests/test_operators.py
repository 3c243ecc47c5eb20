"""Operators against small brute-force forms and invariants."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import linalg, scalars
from tessera.operators import assignment, kmeans, logreg, metrics, ring, sharding, sync_modes, wordcount
from tessera.operators.lbfgs import Trace, minimise
from tessera.sources import generators, points, text
from tessera.sources import metrics as tables
from tessera.streaming import streams

FEATURES = ["f0", "f1"]


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(11)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    x = np.concatenate([c + r.normal(size=(200, 2)) for c in centres])
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=600) > 2.5).astype(int)
    df = spark.createDataFrame([(i % 3, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))], "shard bigint, f0 double, f1 double, label int").cache()
    return df, x, y, np.arange(600) % 3


START = np.array([[1.0, 1.0], [5.0, 1.0], [1.0, 5.0]])


def lloyd(x, c, steps):
    for _ in range(steps):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return c


class TestKMeans:
    def test_stats_match_numpy(self, spark, cloud):
        df, x, _, _ = cloud
        s = kmeans.global_stats(df, FEATURES, START)
        d = ((x[:, None] - START[None]) ** 2).sum(2)
        own = d.argmin(1)
        assert np.allclose(s.counts, np.bincount(own, minlength=3))
        assert np.allclose(s.sums, [x[own == k].sum(0) for k in range(3)])
        assert np.isclose(s.wcss, d.min(1).sum())

    def test_ties_go_to_the_lowest_index(self, spark):
        df = spark.createDataFrame([(0.0, 0.0)], "f0 double, f1 double")
        assert kmeans.assign(df, FEATURES, [[1, 0], [-1, 0], [0, 1]]).first().cluster == 0

    def test_exact_mode_is_lloyd_and_wcss_never_grows(self, spark, cloud):
        df, x, _, _ = cloud
        r = kmeans.fit(df, FEATURES, START, "allreduce_mpi", rounds=4, tol=0.0)
        assert np.allclose(r.centres, lloyd(x, START, 4))
        w = [e["wcss"] for e in r.log]
        assert all(b <= a + 1e-9 for a, b in zip(w, w[1:], strict=False))

    def test_fedavg_matches_numpy(self, spark, cloud):
        df, x, _, shard = cloud
        r = kmeans.fit(df, FEATURES, START, "fedavg_mpi", rounds=2, local_epochs=2, tol=0.0)
        c = START
        for _ in range(2):
            local = [lloyd(x[shard == s], c, 2) for s in range(3)]
            local = [local[0]] + [assignment.align(local[0], m) for m in local[1:]]
            c = sum(m * (shard == s).sum() for s, m in enumerate(local)) / 600
        assert np.allclose(r.centres, c)

    @pytest.mark.parametrize("mode", sorted(sync_modes.MODES))
    def test_one_shard_is_one_model(self, spark, cloud, mode):
        df, x, _, _ = cloud
        one = df.withColumn("shard", F.lit(0).cast("bigint"))
        r = kmeans.fit(one, FEATURES, START, mode, rounds=1, local_epochs=2 if mode != "allreduce_mpi" else 1, tol=0.0)
        assert np.allclose(r.centres, lloyd(x, START, 1 if mode == "allreduce_mpi" else 2))
        assert r.rows == 600

    def test_empty_cluster_stays_or_is_reseeded(self, spark, cloud):
        df, x, _, _ = cloud
        far = np.array([[1.0, 1.0], [5.0, 1.0], [900.0, 900.0]])
        assert np.allclose(kmeans.fit(df, FEATURES, far, "allreduce_mpi", rounds=1).centres[2], [900, 900])
        moved = kmeans.fit(df, FEATURES, far, "allreduce_mpi", rounds=1, reseed=True).centres[2]
        assert np.abs(x - moved).sum(1).min() < 1e-9

    def test_async_follows_the_arrival_log(self, spark, cloud):
        df, x, _, shard = cloud
        r = kmeans.fit(df, FEATURES, START, "ps_async", arrivals=[0, 0, 2], local_epochs=1)
        assert [e["staleness"] for e in r.log] == [0, 0, 2]
        a = lloyd(x[shard == 0], START, 1)
        b = 0.5 * a + 0.5 * lloyd(x[shard == 0], a, 1)
        c = lloyd(x[shard == 2], START, 1)
        assert np.allclose(r.centres, b * (1 - 0.5 / 3) + c * 0.5 / 3)

    def test_gossip_merge_of_equal_states_is_a_fixed_point(self):
        got = kmeans.gossip_merge({s: (START, 1.0, 10) for s in range(4)})
        assert got["converged"] and got["rounds"] == 1 and np.allclose(got["centres"], START) and got["total_rows"] == 40

    def test_seeding(self, spark, cloud):
        df, *_ = cloud
        a, b = (kmeans.initial_centres(df, FEATURES, 3) for _ in range(2))
        assert a.shape == (3, 2) and np.allclose(a, b)
        with pytest.raises(ValueError):
            kmeans.initial_centres(df.where("false"), FEATURES, 3)
        with pytest.raises(ValueError):
            kmeans.fit(df, FEATURES, START, "none", rounds=1, local_epochs=0)


class TestAssignment:
    def test_against_all_matchings(self):
        r = np.random.default_rng(5)
        for n in (1, 3, 5, 7, 8):
            cost = r.random((n, n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
            m = assignment.match(cost)
            assert sorted(m) == list(range(n)) and np.isclose(sum(cost[i, m[i]] for i in range(n)), best)

    def test_align_undoes_a_shuffle(self):
        r = np.random.default_rng(6)
        a = r.random((9, 3))
        assert np.allclose(assignment.align(a, a[r.permutation(9)]), a)


class TestLogReg:
    def loss(self, x, y, m, reg):
        z = x @ m[:-1] + m[-1]
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5 * reg * m[:-1] @ m[:-1]

    def test_loss_and_gradient_by_differences(self, spark, cloud):
        df, x, y, shard = cloud
        m = np.array([0.3, -0.4, 0.2])
        got = logreg.shard_stats(df, FEATURES, "label", {s: m for s in range(3)})
        for s in range(3):
            loss, g = logreg.regularised(got[s], m, 0.1)
            own = shard == s
            assert np.isclose(loss, self.loss(x[own], y[own], m, 0.1))
            for i in range(3):
                step = np.eye(3)[i] * 1e-6
                assert np.isclose(g[i], (self.loss(x[own], y[own], m + step, 0.1) - self.loss(x[own], y[own], m - step, 0.1)) / 2e-6, atol=1e-5)

    def test_lbfgs_reaches_the_optimum(self):
        a = np.diag([1.0, 10.0, 100.0])
        b = np.array([1.0, 2.0, 3.0])
        trace = Trace()
        run = minimise(np.zeros(3), 60, trace)
        x = next(run)
        try:
            while True:
                x = run.send((0.5 * x @ a @ x - b @ x, a @ x - b))
        except StopIteration as e:
            x = e.value
        assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4)
        assert all(q <= p + 1e-12 for p, q in zip(trace.losses, trace.losses[1:], strict=False))

    @pytest.mark.parametrize("mode", sorted(sync_modes.MODES))
    def test_modes_learn(self, spark, cloud, mode):
        df, x, y, _ = cloud
        r = logreg.fit(df, FEATURES, mode=mode, rounds=2, local_steps=5, epochs=8, epoch_rate=0.5)
        assert r.rows == 600 and r.loss < np.log(2)
        assert r.accuracy > (0.85 if mode != "allreduce_mpi" else 0.6)
        if mode == "allreduce_mpi":
            assert r.intercept == 0.0

    def test_gossip_of_two_agrees_in_one_round(self, spark, cloud):
        df, *_ = cloud
        two = df.withColumn("shard", F.col("shard") % 2)
        a = logreg.fit(two, FEATURES, mode="gossip", rounds=1)
        b = logreg.fit(two, FEATURES, mode="fedavg_mpi", rounds=1)
        assert np.allclose(a.weights, b.weights) and np.isclose(a.intercept, b.intercept)

    def test_stops_and_schedules(self):
        assert logreg.converged(1.00001, 1.0, 1e-4) and not logreg.converged(1.1, 1.0, 1e-4) and not logreg.converged(1.0, 1.0, 0)
        assert logreg.cosine_rate(0, 10, 0.1) == pytest.approx(0.1) and logreg.cosine_rate(10, 10, 0.1) == pytest.approx(0.0) and logreg.cosine_rate(3, 1, 0.1) == 0.1


class TestSmall:
    def test_modes_and_ring(self):
        assert sync_modes.normalise(None) == "ps_sync_fedavg_mpi" and sync_modes.normalise(" Async_PS ") == "ps_async"
        with pytest.raises(ValueError):
            sync_modes.normalise("magic")
        assert ring.neighbours(0, 1) == [] and ring.neighbours(0, 2) == [1] and ring.neighbours(0, 5) == [1, 4] and ring.neighbours(1, 4, 9) == [2, 0, 3]

    def test_word_count_of_odd_spaces(self, spark):
        df = spark.createDataFrame([("A a b B\x1cc ",), (None,), ("",)], "text string")
        assert {r.word: r.n for r in wordcount.word_count(df).collect()} == {"a": 2, "b": 2, "c": 1}

    def test_shards_of_few_and_no_lines(self, spark):
        df = spark.createDataFrame([(k, "x" * k) for k in (5, 1, 9)], "k bigint, text string")
        got = {r.k: (r.line, r.shard) for r in sharding.round_robin(df, "k", 2).collect()}
        assert got == {1: (0, 0), 5: (1, 1), 9: (2, 0)}
        assert [r.num_lines for r in sharding.shard_meta(sharding.round_robin(df.where("false"), "k", 3), 3).orderBy("shard").collect()] == [0, 0, 0]
        assert sharding.resolve_workers(None) == 1 and sharding.resolve_workers(0) == 1

    def test_memory_texts(self, spark):
        assert [session.memory_mb(t) for t in ("512m", "4G", "2048k", "1073741824")] == [512, 4096, 2, 1024]
        with pytest.raises(ValueError):
            session.memory_mb("lots")
        with pytest.raises(Exception):
            spark.createDataFrame([("lots",)], "t string").select(scalars.memory_mb(F.col("t"))).collect()
        assert session.baseline_heap_gb(8, 100) == 3 and session.baseline_heap_gb(1, 100) == 2

    def test_stable_terms(self, spark):
        df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "z double")
        got = [tuple(r) for r in df.select(linalg.sigmoid(F.col("z")), linalg.log_one_plus_exp(F.col("z"))).collect()]
        assert got[0] == (0.0, 0.0) and got[1] == pytest.approx((0.5, np.log(2))) and got[2] == (1.0, 800.0)

    def test_nearest_rank_of_none(self, spark):
        df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([],)], "v array<double>")
        assert [r[0] for r in df.select(scalars.nearest_rank(F.col("v"), 95)).collect()] == [3.0, None]

    def test_design(self):
        pts = [(a / 3, b / 3) for a in range(4) for b in range(4)]
        assert metrics.maximin_design(pts, 2) == [0, 15] and metrics.maximin_design([], 3) == []
        assert len(metrics.maximin_design(pts, 16, {0: 1})) == 4


class TestSources:
    def test_points_and_labels_from_files(self, spark, tmp_path):
        (tmp_path / "p.csv").write_text("f0,f1,f2\n1,2,3\n1,2,,3\n1,x,3\n1,2\n\n 4 , 5,6\n")
        lines = spark.read.text(str(tmp_path / "p.csv"))
        assert points.sniff_header(lines) == (True, 3) and points.width_of(lines) == 3
        assert sorted(r.features for r in points.read_points(spark, str(tmp_path / "p.csv")).collect()) == [[1, 2, 3], [1, 2, 3], [4, 5, 6]]
        (tmp_path / "l.csv").write_text("f0,f1,label\n1,2,1\n3,,0\n5,6,0\n")
        assert sorted(tuple(r) for r in points.read_labelled(spark, str(tmp_path / "l.csv"), 2).collect()) == [(1, 2, 1), (5, 6, 0)]
        (tmp_path / "e.csv").write_text("a,b,c\n")
        with pytest.raises(RuntimeError):
            points.read_labelled(spark, str(tmp_path / "e.csv"), 2)
        assert points.check_input(spark, str(tmp_path / "l.csv")) is None and "no line" in points.check_input(spark, str(tmp_path / "e.csv"))
        assert points.check_input(spark, str(tmp_path / "none.csv")).startswith("cannot read")
        assert text.dataset_rows(spark, str(tmp_path / "l.csv")) == 3
        with pytest.raises(ValueError):
            text.read_lines(spark, "")

    def test_metric_tables(self, spark, tmp_path):
        a = spark.createDataFrame([("r", 1, 2.0)], "run_id string, iteration int, weight_norm double")
        tables.append(a, str(tmp_path / "m"), tables.MERGED_ITERATIONS)
        tables.append(a.withColumn("surplus", F.lit(1)), str(tmp_path / "m"), tables.MERGED_ITERATIONS)
        got = tables.read_csv(spark, str(tmp_path / "m"), str(tmp_path / "m*"), schema=tables.MERGED_ITERATIONS)
        assert got.count() == 2 and got.first().local_weight_norm == 2.0
        assert tables.widen(a, a.withColumn("more", F.lit(3))).columns[-1] == "more"
        tables.append_history(a.select(F.struct("run_id").alias("config")), str(tmp_path / "h"))
        assert tables.read_history(spark, str(tmp_path / "h")).first().config.run_id == "r"
        assert tables.markdown(a).splitlines()[0] == "| run_id | iteration | weight_norm |"

    def test_log_blocks(self, spark):
        rows = [(1, k, t) for k, t in enumerate(["Top-20 words:", "  1. the 10", "  2. of 7", "done", "  3. no 1"])]
        got = text.top_words(spark.createDataFrame(rows, "log int, n int, line string"), "log", "n").collect()
        assert sorted((r.word, r.n) for r in got) == [("of", 7), ("the", 10)]

    def test_generators(self, spark, tmp_path):
        assert generators.text_lines(spark, 5).selectExpr("size(split(value, ' ')) n").distinct().collect()[0].n == 20
        n = generators.zipf_lines(spark, 200).selectExpr("size(split(value, ' ')) n").agg(F.min("n"), F.max("n")).first()
        assert 10 <= n[0] <= n[1] <= 20
        s = generators.separable(spark, 400)
        assert s.where("(f0 > 0) = (label = 1)").count() == 400
        m = generators.three_blobs(spark, 600, 2).agg(F.min("f0"), F.max("f0")).first()
        assert m[0] < 4 and m[1] > 13
        assert 0.3 < generators.logistic(spark, 500, [1.0, -1.0]).agg(F.avg("label")).first()[0] < 0.7
        make = lambda: generators.text_lines(spark, 50)
        assert generators.ensure(spark, str(tmp_path / "t"), make, 1000) and not generators.ensure(spark, str(tmp_path / "t"), make, 1000)


def test_streamed_server_folds_in_order(spark, tmp_path):
    rows = [("m", 2, 1, 0, [3.0]), ("m", 1, 0, 0, [1.0]), ("m", 3, 0, 2, [5.0])]
    spark.createDataFrame(rows, "key string, seq bigint, shard bigint, base_version bigint, weights array<double>").coalesce(1).write.parquet(str(tmp_path / "u"))
    got = streams.drain(streams.parameter_server(streams.read_stream(spark, str(tmp_path / "u"))), "append").orderBy("seq").collect()
    assert [(r.version, r.staleness, r.alpha) for r in got] == [(1, 0, 1.0), (2, 1, 0.25), (3, 0, 0.5)]
    assert got[-1].weight_norm == pytest.approx((1 * 0.75 + 3 * 0.25) / 2 + 2.5)


class TestApp:
    def test_wordcount_over_shards_equals_the_baseline(self, spark, tmp_path):
        from tessera import app

        (tmp_path / "t.txt").write_text("spark spark mpi\nmpi spark data\ndata mpi\n" * 7)
        got = app.run(spark, "wordcount", str(tmp_path / "t.txt"), workers=3, compare=True)
        assert got["top"] == got["baseline_top"] == [("mpi", 21), ("spark", 21), ("data", 14)]
        with pytest.raises(ValueError):
            app.run(spark, "sort", str(tmp_path / "t.txt"))

    def test_kmeans_and_logreg_from_files(self, spark, cloud, tmp_path):
        from tessera import app

        _, x, y, _ = cloud
        (tmp_path / "p.csv").write_text("a,b\n" + "\n".join(f"{a},{b}" for a, b in x) + "\n")
        got = app.run(spark, "kmeans", str(tmp_path / "p.csv"), workers=3, reassign=True, compare=True, results_dir=str(tmp_path / "r"))
        assert got["rows"] == 600 and got["wcss"] <= got["baseline_wcss"] * 1.01
        assert spark.read.option("header", True).csv(str(tmp_path / "r/kmeans_ps_sync_fedavg_mpi_iterations")).count() == got["rounds"]
        many = app.run(spark, "kmeans", str(tmp_path / "p.csv"), workers=3, gossip=True, kmeans_iter=2)
        assert many["wcss"] <= got["baseline_wcss"] * 1.1
        (tmp_path / "l.csv").write_text("\n".join(f"{a},{b},{k}" for (a, b), k in zip(x, y, strict=True)) + "\n")
        got = app.run(spark, "logreg", str(tmp_path / "l.csv"), workers=2, logreg_features=2, compare=True)
        assert got["rows"] == 600 and abs(got["accuracy"] - got["baseline_accuracy"]) <= 0.03

    def test_line_numbers_follow_the_file(self, spark, tmp_path):
        (tmp_path / "n.txt").write_text("".join(f"{k}\n" for k in range(1000)))
        df = sharding.line_numbers(spark.read.option("maxPartitionBytes", "200").text(str(tmp_path / "n.txt")))
        assert df.where("cast(value as bigint) <> line").count() == 0 and df.count() == 1000

    def test_recorders(self, spark):
        from tessera.recorders import Recorder, Stopwatch

        k = Recorder.kmeans()
        k.record(iteration=1, sync_time_s=1.0, iter_time_s=4.0, global_wcss=9.0)
        k.record(iteration=2, sync_time_s=1.0, iter_time_s=0.0, global_wcss=8.0)
        assert k.series("sync_overhead_pct") == [25.0, 0.0] and k.last("global_wcss") == 8.0 and k.frame(spark).count() == 2
        with pytest.raises(KeyError):
            k.record(other=1)
        w = Stopwatch()
        assert w.elapsed("x") == 0.0
        with pytest.raises(KeyError):
            w.stop("x")

    def test_summary_figures(self, spark):
        body = "Final |w| : 0.32\nWeighted accuracy:  0.63\nTotal Wall-clock Time   26.05 s\n"
        r = text.summary_figures(spark.createDataFrame([(body,)], "body string"), "body").first()
        assert (r.final_weight_norm, r.weighted_accuracy, r.wall_clock_s, r.proc_time_s) == (0.32, 0.63, 26.05, None)
