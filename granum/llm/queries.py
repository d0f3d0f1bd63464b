"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granum.llm import codes, decontaminate, language, lines, oracles, packing, quality, secrets, sharding, simhash, tokens, topk, urls, whitening
from granum.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those not held out."""
    return language.report(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all documents."""
    return packing.report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that occur before."""
    return lines.report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on all documents."""
    return quality.report(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best other vectors of each query vector."""
    return topk.report(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents."""
    return tokens.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all documents."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.report(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of all documents, near equal in bytes."""
    return sharding.report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors."""
    return codes.report(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all vectors."""
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op3_line_dedup": oracles.OP3, "op5_topk": oracles.OP5, "op9_decontamination": oracles.OP9, "op11_sharding": oracles.OP11, "op12_vector_codes": oracles.OP12}
