"""From raw documents to packed training sequences; every stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import packing, pseudonyms, quality, simhash, templates
from roadweave.llm.registry import SECRET, VOCABULARY
from roadweave.session import shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; null and empty texts go."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group whose SimHash fingerprints (four-word shingles) are linked by at most four bits."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other parameters."""
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal values; n_chars is counted anew (a null text keeps its own)."""
    found = pseudonyms.replace_texts(docs, SECRET)
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of 2048 tokens."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: The classifier is fitted, fingerprints need XXH64 and pseudonyms and tokens have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
