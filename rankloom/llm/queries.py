"""Registered queries of this subpackage: name -> (function of session and folder, DuckDB SQL or None).

Each applies one operator, with production parameters, to the whole ``documents`` table (op13: ``embeddings``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, centroid_clustering, divergence, jaccard_join, language, licenses, mixing, private_data, quality, search, secrets, substring_dedup, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.top_k(docs, docs.where(F.col("doc_id") % 100 == 0))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scanned(documents(spark, sf_dir)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.protected(documents(spark, sf_dir)))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(documents(spark, sf_dir), keep="digest")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(documents(spark, sf_dir))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scanned(documents(spark, sf_dir)))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, None),
    "op2_search": (op2_search, search.SQL),
    "op3_secrets": (op3_secrets, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_jaccard_join": (op5_jaccard_join, None),
    "op6_mixing": (op6_mixing, mixing.SQL),
    "op7_quality": (op7_quality, None),
    "op8_language": (op8_language, None),
    "op9_private_data": (op9_private_data, None),
    "op10_byte_bpe": (op10_byte_bpe, None),
    "op11_source_divergence": (op11_source_divergence, divergence.SQL),
    "op12_licenses": (op12_licenses, licenses.SQL),
    "op13_centroids": (op13_centroids, centroid_clustering.SQL),
}
