"""A training-data pipeline over the documents table: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``docs``. ``run`` applies them to the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from poremetry.llm import bpe, decontaminate, language_id, ngram_join, quality_classifier
from poremetry.workspace import materialize, scoped_tables, ship


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drops documents without a letter and those whose language stays open (score below 0.4)."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: drops documents that are not predicted to be good."""
    ship(spark)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: keeps the document with the smallest id of each group of linked documents."""
    ship(spark)
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: drops documents that hold a test item of the benchmark table."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token counts and digests of the ids and the decoded text of every document that is left."""
    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified),
    ("quality_classifier", good),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

# Trained models and BPE are no SQL material; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Each stage's tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scoped_tables(spark):
            result = stage(spark, docs, sf_dir)
            kept = materialize(result, scoped=False)
        docs = kept
    return docs
