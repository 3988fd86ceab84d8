"""Results as CSV in working order, and content-addressed blobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order in which reviewers work through results.
WORK_ORDER = ("unverified", "unprocessed", "non_document", "duplicate", "verified")


def work_rank(status: Column, unknown: int = -1) -> Column:
    """Place of a status in the working order; other statuses get ``unknown``."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, WORK_ORDER)), status), F.lit(0)).cast("int") - 1, F.lit(unknown))


def write_results(results: DataFrame, path: str, status: str = "verification_status", order: str = "lead_id") -> None:
    """CSV files that, read by name, list the results in working order; ranges are sorted in parallel."""
    ranked = results.withColumn("__rank", work_rank(F.col(status)))
    ranked.orderBy("__rank", order).drop("__rank").write.option("header", True).csv(path)


def append_events(events: DataFrame, path: str, batch: str) -> None:
    """Append events as the batch of this name; a batch that is written again replaces itself, so a stream may repeat its last one."""
    events.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def put_blobs(blobs: DataFrame, store: str, content: str = "content") -> DataFrame:
    """Append the blobs that ``store`` lacks, keyed by SHA-256 and laid out by the key's first byte; returns ``sha256, bytes`` of the new ones.

    Equal blobs are stored once, and a repeated call adds nothing.
    """
    spark = blobs.sparkSession
    keyed = blobs.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    try:
        keyed = keyed.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    except AnalysisException:  # nothing is stored yet
        pass
    batch = F.sha2(F.concat(F.lit("batch"), F.expr("uuid()")), 256)
    name = spark.range(1).select(batch).first()[0]
    keyed.select("sha256", "content", F.length("content").alias("bytes"), F.lit(name).alias("batch"), F.substring("sha256", 1, 2).alias("shard")).write.partitionBy("shard").mode("append").parquet(store)
    return spark.read.parquet(store).where(F.col("batch") == name).select("sha256", "bytes")


def get_blobs(keys: DataFrame, store: str) -> DataFrame:
    """``sha256, content`` for every key; null where the store has none. The shard in the join prunes the files read."""
    held = keys.sparkSession.read.parquet(store).select("sha256", F.col("shard").cast("string").alias("shard"), "content")
    asked = keys.select("sha256", F.substring("sha256", 1, 2).alias("shard")).distinct()
    return asked.join(held, ["sha256", "shard"], "left").select("sha256", "content")
