"""Connected components of a graph that is too large for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame) -> bool:
    """Whether every end stands either in one edge as its greater end, or only as a lesser one: then all components are stars."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("greater"), F.lit(0).alias("lesser")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("greater"), F.lit(1).alias("lesser")))
    return ends.groupBy("id").agg(F.sum("greater").alias("n"), F.max("lesser").alias("root")).where("n > 1 or n = 1 and root = 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the least id that can be reached.

    Self-loops, repeated edges, both directions and null ends are allowed; an edge with a null end links nothing. No neighbour list is
    ever collected: a round is two minima by key, each joined back to the edges.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(now, "edges")
    for _ in range(most_rounds):
        if _stars(now):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = staged(small, "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
