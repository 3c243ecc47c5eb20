"""A training-data pipeline of five corpus operators, from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language, neardup, packing, secrets
from tessera.llm.common import id_crc, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a null ``lang`` takes it.  Rejected ones go."""
    dicts = language.train(docs.where(id_crc("doc_id") % 4 != 2))
    found = language.identify(docs, dicts)
    return found.where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the least id.

    Rows that share an id and not their words are documents of their own.  Rows that repeat both id and text count
    once, that of the least other columns.  Rows without an id stay.
    """
    found = neardup.near_duplicates(docs, keep_hash=True)
    gone = found.where("not kept and doc_id is not null").select("doc_id", F.col("hash").alias("__hash")).distinct()
    kept = docs.where("doc_id is not null").withColumn("__hash", F.xxhash64("text")).join(gone, ["doc_id", "__hash"], "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = kept.groupBy("doc_id", "__hash", "text").agg(F.min(F.struct(*others)).alias("__row")).select("doc_id", "text", "__row.*")
    return kept.select(*docs.columns).unionAll(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate."""
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.where("not contaminated").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced; ``n_chars`` follows the text."""
    found = secrets.scan(docs, secrets.train(secrets.default_samples(spark)))
    changed = F.size("spans") > 0
    out = secrets.redact(found).withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Compression, tokenisation and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
