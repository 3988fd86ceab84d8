"""The operators applied to whole tables: one query for each, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontam, divergence, licenses, mixing, resample, rules, simhash, substring, tokens, topk, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "sha")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.identify_languages(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokens.read_pieces())


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compression.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_quality(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_mixing, op3_licenses, op4_decontamination, op5_language, op6_topk, op7_tokens, op8_substrings, op9_urls, op10_quality,
        op11_rules, op12_divergence, op13_resampling,
    )
}

#: op1, op3, op5, op7, op8, op10, op11 and op13 have no SQL (64-bit hashing over links, learned models, checksums that the SQL engine
#: lacks, or too slow on whole tables); op2 draws at random. Their tests compare with brute force or held-out rows.
ORACLE = {"op4_decontamination": decontam.ORACLE, "op6_topk": topk.ORACLE, "op9_urls": urls.ORACLE, "op12_divergence": divergence.ORACLE}
