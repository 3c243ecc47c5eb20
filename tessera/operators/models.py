"""Model tables: small ones as literals that go to every task, larger ones dealt by shard."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of all shards' models together that are sent as literals; beyond, shards meet their models in a join.
LITERAL_NUMBERS = 1 << 17


def _number(x: float) -> str:
    x = float(x)
    return f"{x!r}D" if x - x == 0 else f"CAST('{x}' AS DOUBLE)"


def model_table(spark: SparkSession, shard: str, models: dict, names: list[str]) -> DataFrame:
    """A row per shard: its key and the numbers of its model, marked for broadcast if they are few."""
    if len(models) * len(names) > LITERAL_NUMBERS:
        columns = [pa.array([int(s) for s in models], pa.int64()), *(pa.array([float(m[i]) for m in models.values()], pa.float64()) for i in range(len(names)))]
        return spark.createDataFrame(pa.table(columns, names=[shard, *names]))
    rows = ", ".join(f"({int(s)}L, " + ", ".join(map(_number, m)) + ")" for s, m in models.items())
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(`{shard}`, {', '.join(f'`{n}`' for n in names)})"))


def by_shard(points: DataFrame, shard: str, features: list[str]) -> DataFrame:
    """The points cached in ranges of their shards, so that a step of one shard skips the others' batches; a large shard is split."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.withColumn(shard, F.col(shard).cast("bigint")).repartitionByRange(n, shard, F.xxhash64(*features)).sortWithinPartitions(shard).cache()
