"""Connected components by alternating large-star and small-star rounds, all of them joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the least of u and all v that stand beside it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its least node) for each end of a link; links: a, b of one orderable type, in any direction.

    Self-links and repeated links change nothing. Each round ends in a written table. No node's links are gathered
    into one row, and a hub's links may be split over tasks, as they meet its minimum in an equi-join.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = _with_least(large)
        small = own.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "components")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
