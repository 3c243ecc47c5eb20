"""How the reference workloads' inputs are taken from the test tables, for the engine and for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 4
POINT_FEATURES = ["f0", "f1", "f2", "f3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features of line items, a 0/1 label, and a shard by order."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % SHARDS).alias("shard"), F.col("l_quantity").alias("f0"), (F.col("l_extendedprice") / 1000).alias("f1"), (F.col("l_discount") * 100).alias("f2"),
        (F.col("l_tax") * 100).alias("f3"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


POINTS = """p AS (
  SELECT l_orderkey % 4 AS shard, l_quantity AS f0, l_extendedprice / 1000 AS f1, l_discount * 100 AS f2, l_tax * 100 AS f3, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem
)"""


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with features of about unit size."""
    return points(spark, sf_dir).withColumns({"f0": F.col("f0") / 50, "f1": F.col("f1") / 100, "f2": F.col("f2") / 10, "f3": F.col("f3") / 8})


SCALED = POINTS + """, q AS (SELECT shard, f0 / 50 AS f0, f1 / 100 AS f1, f2 / 10 AS f2, f3 / 8 AS f3, label FROM p)"""


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as iteration metrics: run, worker, round, and figures made from the event."""
    w = Window.partitionBy("run", "worker").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 4).alias("worker"), "event_id", "user_id", F.col("value").alias("iter_time_s"))
    e = e.withColumn("iteration", F.row_number().over(w).cast("bigint")).withColumn("spark_time_s", F.col("iter_time_s") * (0.3 + 0.01 * (F.col("event_id") % 60)))
    return e.withColumns({
        "sync_time_s": F.col("iter_time_s") - F.col("spark_time_s"), "wcss": 1000.0 / (F.col("iteration") + F.col("event_id") % 7),
        "loss": 2.0 / (1.1 + F.col("iteration")) + F.col("iter_time_s") / 10000, "grad_norm": F.col("iter_time_s") / F.col("iteration"),
        "weight_norm": 1.0 + F.col("event_id") % 11, "row_count": 100 + F.col("event_id") % 50, "exit_code": F.when(F.col("user_id") % 17 == 0, 1).otherwise(0),
        "staleness": F.col("event_id") % 5,
    })


ITERATIONS = """e AS (
  SELECT event_type AS run, user_id % 4 AS worker, event_id, user_id, value AS iter_time_s, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS iteration,
    value * (0.3 + 0.01 * (event_id % 60)) AS spark_time_s FROM events
), m AS (
  SELECT *, iter_time_s - spark_time_s AS sync_time_s, 1000.0 / (iteration + event_id % 7) AS wcss, 2.0 / (1.1 + iteration) + iter_time_s / 10000 AS loss, iter_time_s / iteration AS grad_norm,
    1.0 + event_id % 11 AS weight_norm, 100 + event_id % 50 AS row_count, CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS exit_code, event_id % 5 AS staleness FROM e
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of workloads on some cores: wall time, memory and seconds."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("c_mktsegment").alias("wid"), (F.col("o_orderkey") % 4 + 1).alias("cores"), F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") / (F.col("o_orderkey") % 4 + 1)).alias("wall"),
        (F.col("o_totalprice") / 100 + F.col("o_orderkey") % 97).alias("rss"), (F.col("o_custkey") % 3).alias("driver"),
    )


CELLS = """c AS (
  SELECT c_mktsegment AS wid, o_orderkey % 4 + 1 AS cores, o_orderkey AS run_id, o_totalprice / (o_orderkey % 4 + 1) AS wall, o_totalprice / 100 + o_orderkey % 97 AS rss, o_custkey % 3 AS driver
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
