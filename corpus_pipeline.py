"""A training-data pipeline over ``documents``: toxicity, near-duplicates, contamination, mixing, shards.

Each stage takes what the stage before it kept, written as Parquet in the
shared folder and read again.  Columns that the operators don't need pass
through unchanged, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidseq.llm.common import fresh_dir, keeping_columns, table
from braidseq.llm.decontaminate import find_contamination, with_verdict
from braidseq.llm.mixing import mix_sources
from braidseq.llm.sharding import shard_by_bytes
from braidseq.llm.simhash import keep_one_of_each
from braidseq.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay; null and empty texts are scored like any other, repeated rows alike."""
    model = train_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return keeping_columns(docs, ["doc_id", "text"], lambda d: score_toxicity(d, model).where(F.col("score") < THRESHOLD))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five-word shingles, 0.8 or more), the document with the smallest id stays, null ids last; null and empty texts are one group, of repeated rows one stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go, each row judged by itself; null and empty texts stay."""
    benchmark = table(spark, sf_dir, "benchmark")
    return keeping_columns(docs, ["doc_id", "text"], lambda d: with_verdict(find_contamination(d, benchmark)).where(~F.col("contaminated")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, texts without words are taken or not by their source's part alone."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("repetitions")))
    return keeping_columns(docs, ["doc_id", "text", "source"], lambda d: mix_sources(d).withColumn("copy", copies))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies: one row a document and repetition, null and empty texts with a size of one byte."""
    return shard_by_bytes(docs.select("doc_id", "text"), 8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can express neither the network nor XXH64 fingerprints; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
