"""Training-data pipeline over ``documents``: what is kept, cleaned, mixed and tokenised.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, jaccard_join, language, mixing, private_data
from rankloom.llm.staging import stored
from rankloom.session import ship_package

#: Trained centroids and compared sets have no SQL form; the tests check stages by brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    ship_package(spark)
    return language.accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8)."""
    ship_package(spark)
    return jaccard_join.representatives(docs)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced by their kind."""
    return private_data.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share of the mix takes it."""
    return mixing.resampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``."""
    ship_package(spark)
    return byte_bpe.encoded(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("private_data", without_private_data),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
