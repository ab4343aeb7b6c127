"""A corpus pipeline: five operators in a row, each stage written as Parquet and read again.

Every stage works on all that the one before kept, takes whole texts of any
length, rows that repeat, extra columns of any name and empty tables, which give
empty results. Nulls: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import apportion_mixing, compression_rules, ring_sharding, simhash, suffix_decontam
from planweave.llm.common import new_path

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A null or empty text has no words and is rejected; repeated rows are judged each for itself."""
    return compression_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the document with the smallest id stays; of repeated rows one. A null id is larger than all others, null texts are copies of each other."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. A null text has no words and stays; repeated rows go or stay together; an empty benchmark takes nothing away."""
    return suffix_decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, such that sources meet their targets. A null source is the last one; texts without words are left out; of repeated rows as many are taken as their share asks for."""
    return apportion_mixing.mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, repeats included. A null id is a key of its own, a null text has no bytes; repeated rows have slots of their own."""
    return ring_sharding.shard_rows(docs, shards=SHARDS).select(F.col("key").alias("doc_id"), "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]
#: SQL has neither zstandard nor XXH64; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
