"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpoint


def _lowest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of itself and its neighbours; partial minima come before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _is_star_forest(state: DataFrame) -> bool:
    """Whether each node points to one node at most, and none that points is pointed to."""
    ends = state.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(state.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (u, v): the smallest node that it reaches.

    Each round hooks the larger neighbours of a node (large star), then the smaller ones (small
    star), to the smallest of them; rounds grow with the logarithm of the nodes. Hot nodes are
    pre-aggregated minima and skewed joins, never a window. Loops and repeated edges do no harm.
    """
    own = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    state = checkpoint(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _is_star_forest(state):
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        state = checkpoint(small.where(F.col("u") != F.col("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
