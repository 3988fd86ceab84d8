"""Tables with one row for each key that grow by upserts: bucketed files, a log of batches, compaction of touched buckets only."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import latest

#: Buckets of a table, and keys that are looked up as a list of values: the scan skips row groups by their ranges and Bloom filters.
BUCKETS, LISTED = 64, 1000


class KeyedTable:
    """A table at ``path`` with the key ``keys``: ``base`` holds one row for each key, ``log`` the batches since the last compaction.

    Both hold the bucket (a hash of the key); the base has a folder for each, with files sorted by key that have Bloom
    filters over it. Writing a batch again replaces it, so a stream may repeat its last batch. Columns in ``keep`` have the
    ``min`` or ``max`` of all rows of a key, the others are those of the batch written last; inside a batch the first
    row in column order counts. ``schema`` may be left out where the table has been written before. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | None = None, keep: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.keep, self.buckets = spark, path.rstrip("/"), keys, keep or {}, buckets
        self._schema = schema

    @property
    def schema(self) -> T.StructType:
        if self._schema is None:
            try:
                found = self.spark.read.parquet(f"{self.path}/base").schema
            except AnalysisException:
                found = self.spark.read.parquet(f"{self.path}/log").schema
            self._schema = T.StructType([f for f in found if f.name not in ("bucket", "batch", "seq")])
        return self._schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _part(self, name: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        if name == "log":
            schema = schema.add("seq", T.LongType()).add("batch", T.StringType())
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], schema)

    def _merged(self, base: DataFrame, log: DataFrame) -> DataFrame:
        key = ["bucket", *self.keys]
        rows = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(log.drop("batch"))
        for c, how in self.keep.items():
            rows = rows.withColumn(c, getattr(F, how)(c).over(W.partitionBy(*key)))
        return latest(rows, key, F.desc("seq"), *map(F.col, self.schema.names)).select(*self.schema.names, "bucket")

    def read(self) -> DataFrame:
        """The present rows."""
        return self._merged(self._part("base"), self._part("log")).drop("bucket")

    def write(self, rows: DataFrame, batch: str) -> None:
        """Upsert ``rows`` as the batch of this name."""
        self._schema = self._schema or rows.schema
        placed = rows.select(*self.schema.names, self.bucket().alias("bucket"), F.lit(time.time_ns() // 1000).alias("seq"))
        placed.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def absent(self, rows: DataFrame, batch: str) -> DataFrame:
        """The rows whose keys the table lacked before this batch; of equal keys the first in column order."""
        rows = latest(rows, self.keys, *map(F.col, rows.columns))
        self._schema = self._schema or rows.schema
        return rows.join(self.held(rows, batch), self.keys, "left_anti")

    def held(self, rows: DataFrame, but: str | None = None) -> DataFrame:
        """The keys of ``rows`` that the table has, not counting the batch ``but``. A few keys are looked up by value, in their buckets only."""
        keys = rows.select(*self.keys, self.bucket().alias("bucket")).distinct()
        few = keys.limit(LISTED + 1).collect()
        log = self._part("log")
        log = log if but is None else log.where(F.col("batch") != but)
        both = self._part("base").select("bucket", *self.keys).unionByName(log.select("bucket", *self.keys))
        if len(few) <= LISTED:
            # Longer lists than this setting reach the scan as a range only.
            self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LISTED))
            both = both.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})))
            for k in self.keys:
                both = both.where(F.col(k).isin(sorted({r[k] for r in few if r[k] is not None})))
        return both.join(keys, ["bucket", *self.keys], "left_semi").select(*self.keys).distinct()

    def compact(self) -> list[int]:
        """Fold the log into the base, rewriting the buckets it touches and no others; returns these.

        A compaction that fails may be repeated: merging a batch again changes nothing, and the log goes last.
        """
        log = self._part("log")
        batches = [r[0] for r in log.select("batch").distinct().collect()]
        touched = sorted(r[0] for r in log.select("bucket").distinct().collect())
        if touched:
            base = self._part("base").where(F.col("bucket").isin(touched))
            # One task writes a bucket, so its files are few and sorted.
            rows = self._merged(base, log).repartition(len(touched), "bucket").sortWithinPartitions("bucket", *self.keys)
            write = rows.write.option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.adaptive.enabled", "true")
            for k in self.keys:
                write = write.option(f"parquet.bloom.filter.enabled#{k}", "true")
            write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/base")
        for b in batches:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/batch={b}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return touched
