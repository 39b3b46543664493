"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.llm.common import written


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of the edges (columns a, b of longs).

    Each round links the larger neighbours of every node, then the smaller ones,
    to the smallest neighbour, until nothing changes; every round is a stored
    table.  Hubs meet only in aggregates and in joins that can be split.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star-edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e = written(small, "star-edges")
        now = _signature(e)
        if now == before:
            break
        before = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
