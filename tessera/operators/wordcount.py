"""Word count over sharded texts: partial counts by shard, merged, and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as str.split() sees it, the information separators included.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def words(df: DataFrame, text: str, *keep: str | Column, min_len: int = 1) -> DataFrame:
    """``word`` rows of lower-cased texts with at least ``min_len`` characters; null texts have none."""
    out = df.select(*keep, F.explode(F.split(F.lower(F.col(text)), BLANKS)).alias("word"))
    return out.where(F.length("word") >= min_len)


def word_count(df: DataFrame, text: str = "text", *, min_len: int = 1) -> DataFrame:
    return words(df, text, min_len=min_len).groupBy("word").agg(F.count("*").alias("n"))


def shard_counts(df: DataFrame, shard: Column, text: str = "text", *, min_len: int = 1) -> DataFrame:
    return words(df.withColumn("shard", shard), text, "shard", min_len=min_len).groupBy("shard", "word").agg(F.count("*").alias("n"))


def merge(partials: DataFrame, key: str = "word", value: str = "n") -> DataFrame:
    """Sums partial counts by key; keys are texts and values integers, as their casts give them."""
    return partials.select(F.col(key).cast("string").alias(key), F.col(value).cast("bigint").alias(value)).groupBy(key).agg(F.sum(value).alias(value))


def top(counts: DataFrame, n: int = 20, key: str = "word", value: str = "n") -> DataFrame:
    """The ``n`` largest counts; ties in the order of the keys."""
    return counts.orderBy(F.desc(value), F.asc(key)).limit(n)
