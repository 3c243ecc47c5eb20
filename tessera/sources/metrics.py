"""Metric tables: fixed schemas, readers over many files, appending and widening writers, and run history."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.staging import delete

_KINDS = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def ddl(text: str) -> T.StructType:
    """Columns from "name type, name type"; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in text.split(","))])


# The columns of each table, in order.
KMEANS_ITERATIONS = ddl("iteration int, spark_time_s double, sync_time_s double, iter_time_s double, centroid_shift double, global_wcss double, sync_overhead_pct double")
KMEANS_RUN = ddl("rank int, total_time_s double, iterations_run int, converged boolean, k int, dataset_size bigint, num_ranks int, throughput double")
LOGREG_EPOCHS = ddl("epoch int, spark_time_s double, sync_time_s double, epoch_time_s double, grad_norm double, global_loss double, weight_norm double")
MERGED_ITERATIONS = ddl(
    "run_id string, num_workers int, sync_mode string, reg_param double, num_features int, worker_id int, iteration int, iter_time_s double, weight_norm double, "
    "weight_delta double, local_weight_norm double, intercept double, row_count bigint"
)
STALENESS = ddl("global_version bigint, worker_rank int, worker_round int, row_count bigint, staleness int, alpha_eff double, weight_norm double, elapsed_s double")
SCALAR_ROUNDS = ddl("iteration int, intercept double, elapsed_s double")
TRACE = ddl("rank_idx int, t_s double, cpu_pct double, rss_mb double")


def read_csv(spark: SparkSession, *globs: str, schema: T.StructType | None = None) -> DataFrame:
    """Files of several globs with their names; a file matched twice is read once, and missing columns are null."""
    parts = []
    for g in globs:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(g)
        parts.append(df.withColumn("file", F.col("_metadata.file_path")))
    if len(parts) == 1:
        return parts[0]
    seen, out = parts[0].select("file").distinct(), [parts[0]]
    for p in parts[1:]:
        out.append(p.join(seen, "file", "left_anti"))
        seen = seen.union(p.select("file")).distinct()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def read_latest(spark: SparkSession, glob: str, schema: T.StructType | None = None) -> DataFrame:
    """The most recently changed file of a glob (the last by name of several)."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(glob)
    df = df.withColumns({"__at": F.col("_metadata.file_modification_time"), "__file": F.col("_metadata.file_path")})
    last = df.agg(F.max(F.struct("__at", "__file")).alias("m")).select(F.col("m.__file").alias("__last"))
    return df.join(F.broadcast(last), F.col("__file") == F.col("__last")).drop("__at", "__file", "__last")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, absent ones null and others left out."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def append(df: DataFrame, path: str, schema: T.StructType, by: list[str] | None = None) -> None:
    """Appends conformed rows; in merged iterations an absent local norm is the global one."""
    out = conform(df, schema)
    if "local_weight_norm" in schema.fieldNames():
        out = out.withColumn("local_weight_norm", F.coalesce("local_weight_norm", "weight_norm"))
    writer = out.write.mode("append").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def widen(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the columns of both."""
    return old.unionByName(new, allowMissingColumns=True)


def prepare_table(spark: SparkSession, path: str, schema: T.StructType) -> str:
    """Makes a folder of CSV files ready for rows of ``schema``: ``absent``, ``same``, ``upgraded`` or ``rotated``.

    Old columns that are the first of the new ones are kept and the others left blank; the rows are written beside and
    the folders change names, so a failure leaves one of them whole.  Otherwise the folder is moved aside.
    """
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return "absent"
    old, names = spark.read.option("header", True).csv(path), schema.fieldNames()
    if old.columns == names:
        return "same"
    aside = f"{path.rstrip('/')}.old-{time.strftime('%Y%m%d_%H%M%S')}-{uuid.uuid4().hex[:6]}"
    upgraded = names[: len(old.columns)] == old.columns
    if upgraded:
        old.select(*old.columns, *[F.lit(None).cast("string").alias(n) for n in names[len(old.columns) :]]).write.option("header", True).csv(f"{path.rstrip('/')}.new")
    fs.rename(at, _folder(spark, aside)[1])
    if not upgraded:
        return "rotated"
    fs.rename(_folder(spark, f"{path.rstrip('/')}.new")[1], at)
    delete(spark, aside)
    return "upgraded"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def encode(df: DataFrame, columns: list[str], out: str = "record") -> DataFrame:
    """Columns as one JSON text."""
    return df.withColumn(out, F.to_json(F.struct(*columns))).drop(*[c for c in columns if c != out])


def decode(df: DataFrame, schema: T.StructType, column: str = "record") -> DataFrame:
    """The fields of a JSON text as columns; a broken text gives nulls."""
    names = schema.fieldNames()
    return df.withColumn("__r", F.from_json(column, schema)).drop(column, *names).select("*", *[F.col(f"__r.{n}").alias(n) for n in names]).drop("__r")


def write_report(df: DataFrame, path: str, run_id: str) -> None:
    """Appends a report's rows under their run's id, as CSV with a header."""
    df.select(F.lit(run_id).alias("run_id"), *[c for c in df.columns if c != "run_id"]).write.mode("append").option("header", True).csv(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A report table of at most ``limit`` rows."""
    rows = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(limit).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
