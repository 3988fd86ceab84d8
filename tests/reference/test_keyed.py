"""Tables with one row for each key: results equal a plain upsert, files outside touched buckets stay."""

import os
import random

import pytest
from pyspark.sql import functions as F

from proofmill.operators.keyed import KeyedTable
from proofmill.operators.tables import upsert

SCHEMA = "k string, n int, first_seen int"


def batches(rng, count, size, keys=60):
    return [[(f"k{rng.randrange(keys)}", rng.randrange(1000), rng.randrange(1000)) for _ in range(size)] for _ in range(count)]


def one_each(rows):
    """Of the rows of a key the first in column order."""
    return [min(r for r in rows if r[0] == k) for k in sorted({r[0] for r in rows})]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.mark.parametrize("keep", [None, {"first_seen": "min"}])
def test_equals_upsert(spark, tmp_path, keep):
    rng = random.Random(5)
    schema = spark.createDataFrame([], SCHEMA).schema
    table, plain = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, keep, buckets=8), spark.createDataFrame([], SCHEMA)
    assert table.read().count() == 0 and table.compact() == []
    for i, rows in enumerate(batches(rng, 6, 25)):
        # The minimum of a column is taken over all rows of a batch.
        own = one_each(rows) if not keep else [(*r[:2], min(x[2] for x in rows if x[0] == r[0])) for r in one_each(rows)]
        plain = spark.createDataFrame(upsert(plain, spark.createDataFrame(own, SCHEMA), ["k"], keep).collect(), SCHEMA)
        for _ in range(1 + i % 2):  # again: the same
            table.write(spark.createDataFrame(rows, SCHEMA), f"b{i}")
        if i in (2, 4):
            table.compact()
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, plain.collect())), i
    assert sorted(map(tuple, KeyedTable(spark, str(tmp_path / "t"), ["k"], keep=keep, buckets=8).read().collect())) == sorted(map(tuple, plain.collect()))


def test_compaction_leaves_other_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], SCHEMA).schema, buckets=16)
    table.write(spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("n"), F.lit(2).alias("first_seen")), "a")
    assert len(table.compact()) == 16
    before = files(tmp_path / "t" / "base")
    table.write(spark.createDataFrame([("k7", 9, 9)], SCHEMA), "b")
    (touched,) = table.compact()
    after = files(tmp_path / "t" / "base")
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and all(f"bucket={touched}/" in p for p in changed) and not files(tmp_path / "t" / "log")
    assert table.read().where("n = 9").count() == 1 and table.read().count() == 400
    table.write(spark.createDataFrame([("k7", 9, 9)], SCHEMA), "b")
    assert table.compact() == [touched] and table.read().count() == 400


def test_absent_reads_the_keys_buckets(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, buckets=32)
    table.write(spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("n"), F.lit(2).alias("first_seen")), "a")
    table.compact()
    rows = spark.createDataFrame([("k5", 1, 1), ("new", 2, 2), ("new", 1, 9)], SCHEMA)
    assert sorted(map(tuple, table.absent(rows, "b").collect())) == [("new", 1, 9)]
    plan = table.held(rows)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "k5" in plan.split("PushedFilters")[1]
    many = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("n"), F.lit(2).alias("first_seen"))
    assert table.absent(many, "b").count() == 2500
    table.write(table.absent(many, "b"), "b")
    assert table.absent(many, "b").count() == 2500 and table.absent(many, "c").count() == 0 and table.read().count() == 3000
