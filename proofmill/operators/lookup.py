"""Tables laid out for lookups of single keys: a folder for each bucket of keys, files of consecutive keys, Bloom filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_clustered(rows: DataFrame, path: str, key: str, *order: str, buckets: int = BUCKETS) -> None:
    """Append ``rows`` so that those of a key lie together, in ``order``.

    Ranges of bucket and key are dealt out, so a bucket may be written by several tasks, whose files then hold different keys.
    """
    placed = rows.withColumn("bucket", _bucket(F.col(key), buckets)).repartitionByRange("bucket", key).sortWithinPartitions("bucket", key, *order)
    placed.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("bucket").mode("append").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of one key: the folder follows from the key, the files' statistics and Bloom filters leave one row group."""
    return spark.read.parquet(path).where((F.col("bucket") == _bucket(F.lit(value), buckets)) & (F.col(key) == value)).drop("bucket")


def journey(spark: SparkSession, path: str, lead_id: str, buckets: int = BUCKETS) -> DataFrame:
    """What happened to a lead, in order, from events that :func:`write_clustered` wrote by ``lead_id``."""
    return lookup(spark, path, "lead_id", lead_id, buckets).orderBy("id")
