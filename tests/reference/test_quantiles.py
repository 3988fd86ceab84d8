"""Exact percentiles by distributed selection against Spark's own."""

import random

from pyspark.sql import functions as F

from proofmill.operators.quantiles import quantiles

WANTED = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def both(df, keys):
    plain = df.where("v IS NOT NULL").groupBy(*keys).agg(*(F.expr(f"percentile(v, {q}D)").alias(n) for n, q in WANTED.items()))
    return [sorted(map(tuple, x.select(*keys, *WANTED).collect()), key=repr) for x in (quantiles(df, keys, "v", WANTED), plain)]


def test_equal_to_percentile(spark):
    rng = random.Random(6)
    rows = [("hot", i % 3, rng.gauss(0, 100)) for i in range(4000)] + [(f"g{i % 40}", None, float(rng.randrange(5))) for i in range(300)]
    rows += [(None, 1, 2.5), (None, 1, None), ("nulls", 1, None), ("one", 1, -7.0), ("hot", 0, float("-inf")), ("same", 2, 3.0), ("same", 2, 3.0)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(7)
    for keys in (["g", "h"], ["g"], []):
        got, want = both(df, keys)
        assert got == want and got, keys


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles(df, ["g"], "v", WANTED).count() == 0 and quantiles(df, [], "v", WANTED).count() == 0
