"""Sources and sinks over files that the queries write to the shared folder first, and generators by what they promise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import sharding
from tessera.plans.tables import POINT_FEATURES, POINTS, points, table
from tessera.sources import generators
from tessera.sources import metrics as tables
from tessera.sources import points as point_files
from tessera.sources import text as logs
from tessera.staging import delete, shared_folder

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _lines(spark: SparkSession, lines: list[str]) -> str:
    """A file of a few lines, one partition, in order."""
    path = shared_folder(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


_SUMS = ", ".join(f"round(sum(f{i}), 4) AS s{i}" for i in range(4))


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), *(F.round(F.sum(f), 4).alias(f"s{i}") for i, f in enumerate(POINT_FEATURES)))


@query(f"WITH {POINTS} SELECT label, count(*) AS n, {_SUMS} FROM p GROUP BY label")
def src_inferred(spark, sf):
    """Points written with a header and read with inferred types."""
    path = shared_folder(spark)
    points(spark, sf).select(*POINT_FEATURES, "label").write.option("header", True).csv(path)
    return _sums(point_files.read_inferred(spark, path))


@query(f"WITH {POINTS} SELECT label, count(*) AS n, {_SUMS} FROM p GROUP BY label")
def src_labelled(spark, sf):
    """Points written without a header and read under the fixed schema; broken lines beside them go."""
    path = shared_folder(spark)
    points(spark, sf).select(*POINT_FEATURES, "label").write.csv(path)
    spark.createDataFrame([("f0,f1,f2,f3,label",), ("1,x,3,4,0",), ("1,2",)], "value string").write.mode("append").text(path)
    return _sums(point_files.read_labelled(spark, path, 4))


@query(f"WITH {POINTS}, m AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS d0, avg(f3) AS m3, stddev_pop(f3) AS d3 FROM p) SELECT label, round(sum((f0 - m0) / d0), 3) AS z0, round(sum((f3 - m3) / d3), 3) AS z3 FROM p, m GROUP BY label")
def src_standardised(spark, sf):
    path = shared_folder(spark)
    points(spark, sf).select(*POINT_FEATURES, "label").write.csv(path)
    got, _ = point_files.read_standardised(spark, path, 4)
    return got.groupBy(F.col("label").cast("int").alias("label")).agg(F.round(F.sum("f0"), 3).alias("z0"), F.round(F.sum("f3"), 3).alias("z3"))


@query(f"WITH {POINTS} SELECT label, count(*) AS n FROM p WHERE f0 + f1 > 0 GROUP BY label")
def src_assembled(spark, sf):
    """Feature columns as a vector and back."""
    from pyspark.ml.functions import vector_to_array

    got = point_files.assemble(points(spark, sf), POINT_FEATURES).withColumn("v", vector_to_array("features"))
    return got.where(F.get("v", 0) + F.get("v", 1) > 0).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY 1")
def src_globs(spark, sf):
    """Files that two globs both match count once."""
    path = shared_folder(spark)
    nation = table(spark, sf, "nation")
    for k in range(2):
        nation.where(F.col("n_nationkey") % 2 == k).coalesce(1).write.option("header", True).csv(f"{path}/part{k}")
    got = tables.read_csv(spark, f"{path}/part*/*.csv", f"{path}/part1/*.csv", schema=tables.ddl("n_nationkey int, n_name string, n_regionkey int"))
    return got.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 1")
def src_latest(spark, sf):
    """Only the file that was written last."""
    path = shared_folder(spark)
    for k in range(2):
        table(spark, sf, "region").where(F.col("r_regionkey") == k).coalesce(1).write.option("header", True).csv(f"{path}/t{k}")
    return tables.read_latest(spark, f"{path}/t*/*.csv", tables.ddl("r_regionkey int, r_name string"))


@query("SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false)) t(file, usable)")
def src_checked(spark, sf):
    found = [point_files.check_input(spark, _lines(spark, lines)) is None for lines in (["f0,f1", "1,2"], ["1,2"], ["a,b", "c,d"], [""])]
    return spark.createDataFrame(list(enumerate(found, 1)), "file int, usable boolean")


@query("SELECT CAST(4 AS BIGINT) AS data_rows, 'a,b' AS head, CAST(20 AS BIGINT) AS size, substr(sha256('a,b' || chr(10) || '1,2' || chr(10) || '3,4' || chr(10) || '5,6' || chr(10) || '7,8' || chr(10)), 1, 16) AS digest")
def src_file_facts(spark, sf):
    """Rows under the header, the first line, the size and the digest of a file."""
    path = _lines(spark, ["a,b", "1,2", "3,4", "5,6", "7,8"])
    digest = logs.file_digest(spark, f"{path}/part-*").first()["digest"]
    row = (logs.dataset_rows(spark, path), logs.read_head(spark, path, 1).first()["value"], logs.read_whole(spark, path).first()["size"], digest)
    return spark.createDataFrame([row], "data_rows bigint, head string, size bigint, digest string")


@query("SELECT CAST(o_orderkey % 4 AS INT) AS shard, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT -1, 0")
def snk_shards(spark, sf):
    """Shards written, read back and cleaned away (-1: what is left)."""
    path = shared_folder(spark)
    sharding.write_shards(table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("shard")), path)
    rows = [(r.shard, r.n) for r in spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    sharding.clean_shards(spark, path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    left = int(fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs))
    return spark.createDataFrame([*rows, (-1, left)], "shard int, n bigint")


@query("SELECT r_regionkey AS a, r_name AS b, NULL::VARCHAR AS c FROM region UNION ALL SELECT n_nationkey, n_name, 'new' FROM nation")
def snk_upgraded(spark, sf):
    """A table of an older schema, upgraded and appended to."""
    path, schema = shared_folder(spark), tables.ddl("a int, b string, c string")
    table(spark, sf, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b")).write.option("header", True).csv(path)
    tables.prepare_table(spark, path, schema)
    tables.append(table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"), F.lit("new").alias("c")), path, schema)
    return spark.read.option("header", True).schema(schema).csv(path)


@query("SELECT n_regionkey, n_name FROM nation")
def snk_history(spark, sf):
    """Records appended as JSON in two runs and read as one history."""
    path = shared_folder(spark)
    for k in range(2):
        tables.append_history(table(spark, sf, "nation").where(F.col("n_nationkey") % 2 == k).select("n_regionkey", "n_name"), path)
    return tables.read_history(spark, path).select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n_name")


@query("SELECT CAST(run_id AS VARCHAR) AS run_id, r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM region, (VALUES ('r1'), ('r2')) t(run_id)")
def snk_report(spark, sf):
    """Reports of two runs under one path."""
    path = shared_folder(spark)
    report = table(spark, sf, "region").select("r_name", F.when(F.col("r_regionkey") % 2 == 0, "PASS").otherwise("FAIL").alias("status"))
    for run in ("r1", "r2"):
        tables.write_report(report, path, run)
    return spark.read.option("header", True).csv(path)


@query("SELECT 1 AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 2, '| --- | --- |' UNION ALL SELECT CAST(3 + r_regionkey AS INT), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def snk_markdown(spark, sf):
    """A small table as Markdown lines."""
    text = tables.markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line int, text string")


@query("SELECT * FROM (VALUES ('text', 500, 20, 20), ('zipf', 500, 10, 20)) t(kind, lines, least, most)")
def gen_text(spark, sf):
    """Lines of the promised numbers of words."""
    out = None
    for kind, df in (("text", generators.text_lines(spark, 500)), ("zipf", generators.zipf_lines(spark, 500))):
        n = F.size(F.split("value", " "))
        one = df.agg(F.lit(kind).alias("kind"), F.count("*").cast("int").alias("lines"), F.min(n).alias("least"), F.max(n).alias("most"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT * FROM (VALUES ('separable', CAST(1000 AS BIGINT), 11, true), ('classification', CAST(1000 AS BIGINT), 11, true), ('logistic', CAST(1000 AS BIGINT), 4, true), ('three_blobs', CAST(1000 AS BIGINT), 10, true), ('blobs', CAST(1000 AS BIGINT), 3, true)) t(kind, n, width, apart)")
def gen_points(spark, sf):
    """Sizes and widths, and classes or blobs that lie where they should."""
    gap = lambda df: df.groupBy("label").agg(F.avg("f0").alias("m")).agg(F.max("m") - F.min("m")).first()[0]
    made = {
        "separable": (generators.separable(spark, 1000), lambda d: gap(d) > 5), "classification": (generators.classification(spark, 1000), lambda d: d.select("label").distinct().count() == 2),
        "logistic": (generators.logistic(spark, 1000, [2.0, 0.0, 0.0]), lambda d: gap(d) > 0.5), "three_blobs": (generators.three_blobs(spark, 1000), lambda d: 7 < d.agg(F.avg("f0")).first()[0] < 10),
        "blobs": (generators.blobs(spark, 1000, [[0.0, 0.0], [50.0, 0.0]], 1.0), lambda d: d.groupBy("blob").agg(F.avg("f0").alias("m")).agg(F.max("m")).first()[0] > 45),
    }
    return spark.createDataFrame([(k, d.count(), len(d.columns), bool(ok(d))) for k, (d, ok) in made.items()], "kind string, n bigint, width int, apart boolean")


@query("SELECT * FROM (VALUES (1, 2, 6, 5), (4, 2, 6, 5), (16, 5, 2, 1)) t(threads, heap_gb, up, down)")
def resource_shares(spark, sf):
    """Heap of a baseline by its threads, and cores of each worker rounded either way."""
    rows = [(t, session.baseline_heap_gb(t, 16.0), sharding.cores_each(*s), sharding.cores_each(*s, False)) for t, s in ((1, (22, 4)), (4, (22, 4)), (16, (4, 3)))]
    return spark.createDataFrame(rows, "threads int, heap_gb int, up int, down int")


_BLOCK = ("noise", "Top-20 words:", "  1. the   12", "  2. of   7", "Final |w| : 1.25", "  3. late 1", "Weighted accuracy:  0.875", "Total Wall-clock Time   12.5 s", "Processing Time (avg fit)  3.25 s")


@query("SELECT * FROM (VALUES ('the', CAST(12 AS BIGINT)), ('of', CAST(7 AS BIGINT))) t(word, n)")
def log_top_words(spark, sf):
    """The block of most frequent words in a log, up to the first line that is no entry."""
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(_BLOCK)], "log int, line_no int, line string")
    return logs.top_words(lines, "log", "line_no").select("word", "n")


@query("SELECT 1.25 AS final_weight_norm, 0.875 AS weighted_accuracy, 12.5 AS wall_clock_s, 3.25 AS proc_time_s".replace(" AS", "::DOUBLE AS"))
def log_summary(spark, sf):
    return logs.summary_figures(spark.createDataFrame([("\n".join(_BLOCK),)], "body string"), "body")


@query("SELECT true AS written, false AS again, true AS after_delete")
def gen_ensured(spark, sf):
    """A file is made only where it is not there already."""
    path = shared_folder(spark)
    make = lambda: generators.text_lines(spark, 100)
    found = [generators.ensure(spark, path, make, 5000), generators.ensure(spark, path, make, 5000)]
    delete(spark, path)
    found.append(generators.ensure(spark, path, make, 5000))
    return spark.createDataFrame([tuple(found)], "written boolean, again boolean, after_delete boolean")
