"""Exact percentiles of groups of any size: no task and no row holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """``keys`` and a column for each of ``wanted`` (name to share): what ``percentile`` gives, by distributed selection.

    Different values are counted before the shuffle and dealt out by ranges of key and value. The sizes of the ranges, a few
    rows for each group, tell which range holds a wanted rank; only these ranges are read again, each on its own. Null values
    do not count; groups of nulls only are left out. ``weight`` is a column that says how often a row counts.
    """
    at = [f"k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(a) for k, a in zip(keys, at)), F.col(value).cast("double").alias("value"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))
    counted = rows.groupBy(*at, "value").agg(F.sum("n").alias("n"))
    ranged = materialise(counted.repartitionByRange(*at, "value").withColumn("range", F.spark_partition_id()))
    group = W.partitionBy(*at)
    sizes = ranged.groupBy(*at, "range").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(group.orderBy("range")) - F.col("size")).withColumn("total", F.sum("size").over(group))
    place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*(f(place(q)).cast("long") for q in wanted.values() for f in (F.floor, F.ceil))))
    holders = sizes.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))).where(F.size("ranks") > 0)
    a, b = ranged.alias("a"), holders.select(*at, "range", "before", "ranks").alias("b")
    inside = a.join(b, _same([*at, "range"], "a", "b")).select(*(f"a.{k}" for k in at), "a.range", "value", "n", "before", "ranks")
    low = F.col("before") + F.sum("n").over(W.partitionBy(*at, "range").orderBy("value")) - F.col("n")
    hits = inside.withColumn("low", low).withColumn("rank", F.explode(F.filter("ranks", lambda r: (r >= F.col("low")) & (r < F.col("low") + F.col("n")))))
    found = hits.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))
    totals = sizes.select(*at, "total").distinct().alias("t")
    joined = totals.join(found.alias("f"), _same(at, "t", "f")).select(*(f"t.{k}" for k in at), "t.total", "f.of")

    def between(q: float) -> Column:
        p = place(q)
        lo, hi = F.floor(p).cast("long"), F.ceil(p).cast("long")
        return F.when(lo == hi, F.element_at("of", lo)).otherwise((hi - p) * F.element_at("of", lo) + (p - lo) * F.element_at("of", hi))

    return joined.select(*(F.col(a).alias(k) for k, a in zip(keys, at)), *(between(q).alias(name) for name, q in wanted.items()))


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out
