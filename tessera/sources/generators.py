"""Seeded generators: rows come from ``spark.range``, so they are made where they are written."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary of generated texts.
VOCABULARY = "spark data cluster node worker driver shuffle partition task stage job memory core executor cache broadcast join filter map reduce".split()


def _pick(items: Column, size: int, *keys) -> Column:
    return F.element_at(items, (F.pmod(F.xxhash64(*keys), F.lit(size)) + 1).cast("int"))


def text_lines(spark: SparkSession, lines: int, words: int = 20, seed: int = 42) -> DataFrame:
    """``value``: lines of ``words`` words, each drawn alike from a small vocabulary."""
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    return spark.range(lines).select(F.array_join(F.array(*[_pick(vocabulary, len(VOCABULARY), "id", F.lit(seed), F.lit(k)) for k in range(words)]), " ").alias("value"))


def zipf_lines(spark: SparkSession, lines: int, vocabulary: int = 5000, seed: int = 42) -> DataFrame:
    """Lines of 10 to 20 words whose ranks follow a Zipf law, by its inverse distribution (log-uniform ranks)."""
    n = 10 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(11)).cast("int")
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(1 << 30)) / float(1 << 30)
    word = lambda k: F.concat(F.lit("w"), F.floor(F.exp(unit(k) * F.log(F.lit(float(vocabulary + 1))))).cast("string"))
    return spark.range(lines).select(F.array_join(F.transform(F.sequence(F.lit(1), n), word), " ").alias("value"))


def blobs(spark: SparkSession, rows: int, centres: list[list[float]], sigma: float, seed: int = 42) -> DataFrame:
    """``f0..`` and ``blob``: rows around centres in turn."""
    d = len(centres[0])
    at = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    out = spark.range(rows).withColumn("blob", F.col("id") % len(centres))
    return out.select("blob", *[(F.element_at(F.element_at(at, (F.col("blob") + 1).cast("int")), j + 1) + F.randn(seed + j) * sigma).alias(f"f{j}") for j in range(d)])


def three_blobs(spark: SparkSession, rows: int, width: int = 10, seed: int = 42) -> DataFrame:
    return blobs(spark, rows, [[c] * width for c in (2.0, 8.0, 15.0)], 1.5, seed).drop("blob")


def separable(spark: SparkSession, rows: int, width: int = 10, noise: float = 0.5, seed: int = 42) -> DataFrame:
    """Two classes, apart on the first feature by a margin of max(2, 0.3 width) on either side."""
    margin = max(2.0, 0.3 * width)
    out = spark.range(rows).withColumn("label", (F.col("id") % 2).cast("int"))
    first = (F.randn(seed) * noise + F.when(F.col("label") == 1, margin).otherwise(-margin)).alias("f0")
    return out.select(first, *[(F.randn(seed + j) * noise).alias(f"f{j}") for j in range(1, width)], "label")


def logistic(spark: SparkSession, rows: int, weights: list[float], seed: int = 42) -> DataFrame:
    """Normal features, and labels drawn with probability sigmoid(x w)."""
    d = len(weights)
    out = spark.range(rows).select(*[F.randn(seed + j).alias(f"f{j}") for j in range(d)], F.rand(seed + d).alias("__u"))
    z = reduce(lambda a, b: a + b, [F.col(f"f{j}") * w for j, w in enumerate(weights)])
    return out.withColumn("label", (F.col("__u") < 1 / (1 + F.exp(-z))).cast("int")).drop("__u")


def classification(spark: SparkSession, rows: int = 540_000, width: int = 10, informative: int = 5, flip: float = 0.01, apart: float = 1.0, seed: int = 42) -> DataFrame:
    """``f0..`` and ``label``: two clusters of each class at vertices of a cube of the informative features.

    The other features are fixed random mixtures of the informative ones and noise; a share ``flip`` of labels is
    drawn anew.
    """
    rng = np.random.default_rng(seed)
    corners = (rng.permutation(1 << informative)[:4, None] >> np.arange(informative) & 1) * 2 - 1
    mixture = rng.uniform(-1, 1, (width - informative, informative))
    out = spark.range(rows).withColumn("__c", (F.col("id") % 4).cast("int"))
    at = F.array(*[F.array(*[F.lit(float(x) * apart) for x in c]) for c in corners])
    for j in range(informative):
        out = out.withColumn(f"f{j}", F.get(F.get(at, F.col("__c")), j) + F.randn(seed + j))
    for j in range(width - informative):
        mixed = reduce(lambda a, b: a + b, [F.col(f"f{i}") * float(w) for i, w in enumerate(mixture[j])])
        out = out.withColumn(f"f{informative + j}", mixed + F.randn(seed + informative + j) * 0.1)
    drawn = F.rand(seed + width)
    out = out.withColumn("__u", drawn)
    return out.select(*[f"f{j}" for j in range(width)], F.when(F.col("__u") < flip / 2, 0).when(F.col("__u") < flip, 1).otherwise(F.col("__c") % 2).alias("label"))


def published(spark: SparkSession, scale: float = 1.0, seed: int = 42) -> dict[str, DataFrame]:
    """The published data sets at their sizes: 540,000 x 10 labelled rows, 540,000 x 8 rows around five centres, a million Zipf words."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (5, 8)).tolist()
    rows = int(540_000 * scale)
    return {"logreg": classification(spark, rows, seed=seed), "kmeans": blobs(spark, rows, centres, 1.8, seed).drop("blob"), "wordcount": zipf_lines(spark, int(66_667 * scale), 5000, seed)}


def ensure(spark: SparkSession, path: str, make, least_bytes: int) -> bool:
    """Writes ``make()`` as lines of text unless the path holds 80 % of ``least_bytes`` already; tells whether it wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and fs.getContentSummary(hadoop).getLength() >= 0.8 * least_bytes:
        return False
    make().write.mode("overwrite").text(path)
    return True
