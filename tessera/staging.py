"""A folder that all executors share, for tables and stream checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Only a local master may go without that setting (as in tests): elsewhere a folder of one machine would be lost
    with it, so an error is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/tessera-checkpoints"
    return f"{base.rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in this application's shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path by whichever file system it lies on; a path that is not there is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the table that ``stage`` wrote for ``df``; nothing that still reads it may run later."""
    path = getattr(df, "_staged_at", None)
    if path:
        delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Deletes every table and stream state of this application; results that still read them must be written before."""
    delete(spark, shared_root(spark))
