"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.session import cut


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex of its component.

    Each round links every vertex's larger neighbours, then its smaller ones, to
    the smallest vertex it knows; the rounds needed grow with the logarithm of
    the longest path.  Each round is cut off in the shared folder.  A vertex
    with very many neighbours is one sorted group of pairs that can spill.  More
    than ``rounds`` rounds are an error.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(W.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.select("a", "b", F.min("b").over(W.partitionBy("a")).alias("m"))
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = cut(small.where("a != b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    return now.select(F.col("a").alias("v"), F.col("b").alias("c")).union(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
