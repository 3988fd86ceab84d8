"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import compression, decontam, mixing, simhash, substring
from proofmill.llm.common import discard, materialise, packed, unpacked
from proofmill.llm.queries import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier calls good.

    Nulls, empty and long texts, repeated rows, ties and clashing columns: as in ``compression.score_quality``; a score of
    one half is good. Empty tables stay empty, and without labels the plain size difference decides.
    """
    scored = compression.score_quality(docs.select("doc_id", "text", packed(docs)), table(spark, sf_dir, "labels"))
    return unpacked(scored.where("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; that with the smallest id.

    Null ids come last; null texts count as empty, which are copies of each other; repeated rows are copies. Texts of any
    length are compared whole. Empty tables stay empty; other columns are kept as they are.
    """
    return simhash.dedup_near(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that stand earlier; those of which nothing is left go.

    Null and empty texts have no passages and stay as they are; null ids come first, and repeated rows are one document, as in
    ``substring.dedup_substrings``. ``n_chars`` follows the text. Empty tables stay empty; clashing columns keep their values.
    """
    rows = docs.select("doc_id", "text", packed(docs))
    cut = substring.dedup_substrings(rows).where("n_removed = 0 OR kept <> ''")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        old = F.col(f"row.c{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(old)
    return unpacked(cut, docs.columns, **changed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and short texts hold none, and items without five words are in none; ids may be null or repeat. An empty
    benchmark keeps all, an empty table stays empty, and other columns are kept as they are.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: blocks of words in the slots of its shards.

    Null and empty texts give no block; null is a source like any other; rows equal in id and size are interchangeable.
    Empty tables give no slot; columns other than id, text and source are not read.
    """
    return mixing.mixed_blocks(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]

#: SQL cannot express the learned and hashed stages; tests/llm/test_pipeline.py compares each, and run(), with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of a folder of tables; what a stage wrote is deleted once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return docs
