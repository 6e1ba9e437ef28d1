"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (a long, b long); component is the smallest id of its component.

    Alternates large-star and small-star steps, which need a logarithmic number
    of rounds and never gather a vertex's neighbours. Each round is
    checkpointed. Only a count and a sum come to the driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: what is larger than a goes to the least neighbour of a.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a and what is smaller than a go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = cut(small.where("a <> b").distinct())
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
