"""The cache of model answers: probed by content, filled by answers without an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import insert_if_absent


def cache_key(image_b64: Column, model: Column, version: int) -> Column:
    """The key of an encoded image under a model and a version of the prompt."""
    return F.concat(F.sha2(image_b64, 256), F.lit(":"), model, F.lit(f":v{version}"))


def probe(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``cached`` (the extraction, or null) and ``cache`` (hit or miss) to rows with a ``cache_key``."""
    held = cache.select("cache_key", F.col("extraction").alias("cached"))
    return rows.join(held, "cache_key", "left").withColumn("cache", F.when(F.col("cached").isNotNull(), "hit").otherwise("miss"))


def counted(cache: DataFrame, probed: DataFrame) -> DataFrame:
    """``cache`` after the probes: every hit counts."""
    hits = probed.where("cache = 'hit'").groupBy("cache_key").agg(F.count("*").alias("__n"))
    return cache.join(hits, "cache_key", "left").withColumn("hits", F.col("hits") + F.coalesce("__n", F.lit(0))).drop("__n")


def filled(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """``cache`` with the answers (``cache_key, extraction, model, error``) that it lacks; failed calls leave no trace."""
    good = answers.where(F.coalesce("error", F.lit("")) == "").select("cache_key", "extraction", "model", F.lit(0).cast("long").alias("hits"))
    return cache.unionByName(insert_if_absent(cache, good, ["cache_key"], F.asc("extraction")))


def stats(cache: DataFrame) -> DataFrame:
    """``entries`` and the ``hits`` they have served."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
