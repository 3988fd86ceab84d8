"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, root`` for every node of ``edges(u, v)``; root is the smallest node it can reach.

    Each round first hangs the larger neighbours of every node on the node's minimum, then the smaller
    ones. Edges never multiply, rounds grow with the logarithm of a component's diameter, and only a
    two-number summary reaches the driver: joins are by shuffle. Rounds are written tables, so lost executors cost one round.
    Self-links and repeated links are harmless; an empty table gives an empty result.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        summary = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if summary == seen:
            break
        seen = summary
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(apart(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(apart(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
