"""Shards as a column: round robin, contiguous blocks, and what each shard holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import by_range, cuts_of, range_of
from tessera.staging import delete


def resolve_workers(workers: int | None) -> int:
    return max(1, int(workers)) if workers is not None else 1


def cores_each(total: int, workers: int, whole: bool = True) -> int:
    """Cores of each worker: rounded up where workers share a machine in turn (``whole``), down for a fair baseline; one at least."""
    return max(1, -(-total // workers) if whole else total // workers)


def by_key(key: str, shards: int) -> Column:
    return F.pmod(F.col(key), F.lit(shards))


def numbered(df: DataFrame, order: str, buckets: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``line``, each row's number from 0 by ``order`` (an integer), then by ``ties``.

    Rows are dealt into ranges by quantiles, numbered within a range, and shifted by the rows of the ranges before,
    so no task sees all rows.
    """
    n = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cuts_of(df, order, n)
    ranged = df.withColumn("__range", F.expr(range_of(order, cuts)))
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}  # a row per range
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    own = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties))
    return ranged.withColumn("line", (own - 1 + F.expr(by_range(before, len(cuts) + 2, "__range"))).cast("bigint")).drop("__range")


def round_robin(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Line i goes to shard i mod ``shards``."""
    return numbered(df, order).withColumn("shard", F.col("line") % shards)


def contiguous(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Blocks of ceil(n / shards) lines; the last may be short or empty."""
    lines = numbered(df, order)
    size = -(-df.count() // shards) or 1
    return lines.withColumn("shard", F.floor(F.col("line") / size))


def shard_meta(df: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """A row per shard, empty ones included: lines, bytes with line ends, and the nominal first and last line of equal blocks."""
    held = df.groupBy("shard").agg(F.count("*").alias("num_lines"), F.sum(F.octet_length(text) + 1).alias("file_size_bytes"))
    every = df.sparkSession.range(shards).withColumnRenamed("id", "shard").join(held, "shard", "left").withColumn("total", F.lit(df.count()))
    block = F.ceil(F.col("total") / shards)
    start = F.col("shard") * block
    return every.select(
        "shard", F.coalesce("num_lines", F.lit(0)).alias("num_lines"), F.coalesce("file_size_bytes", F.lit(0)).cast("bigint").alias("file_size_bytes"),
        start.cast("bigint").alias("start_line"), F.least(start + block, F.col("total")).cast("bigint").alias("end_line"),
    )


def line_numbers(lines: DataFrame) -> DataFrame:
    """Adds ``line``, a file's line numbers from 0: rows keep their partition, and only partitions' sizes are gathered."""
    own = lines.withColumn("__id", F.monotonically_increasing_id())
    # The high bits name the partition, the low 33 the row in it.
    sizes = {r["p"]: r["count"] for r in own.groupBy(F.shiftright("__id", 33).alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    shift = by_range(before, max(sizes, default=0) + 1, "cast(shiftright(__id, 33) as int)")
    return own.withColumn("line", F.expr(f"{shift} + (__id & {(1 << 33) - 1}L)")).drop("__id")


def write_shards(df: DataFrame, path: str) -> None:
    """A folder for each shard; many files at once."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)


def clean_shards(spark: SparkSession, path: str) -> None:
    """Deletes what ``write_shards`` wrote; a path that is not there is no error."""
    delete(spark, path)
