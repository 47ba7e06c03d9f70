"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.joins import join_groups
from twinfold.session import materialize


def _neighbours(edges: DataFrame) -> DataFrame:
    """``(u, m, degree)``: ``m`` is the smallest of ``u`` and its neighbours. Combined before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(ends: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it; rows of a node with very many neighbours are salted."""
    linked = join_groups(ends, nodes, ["u"], "degree", total=total)
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; every ``v`` is below its ``u``."""
    linked = join_groups(edges, _neighbours(edges), ["u"], "degree", total=total)
    # The row of the smallest neighbour itself carries the link of ``u``.
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return linked.select(moved.alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``, stored; component = smallest node.

    The nodes with the smallest node around them, which each round starts from, also tell whether it is the last one:
    all nodes are the smallest around them or have one neighbour only, so the edges are stars.
    Each round is written to the shared folder, so a lost executor costs one round.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        ends = both_ways(current)
        nodes = materialize(_neighbours(ends))
        open_ = F.coalesce(F.max((F.col("m") != F.col("u")) & (F.col("degree") > 1)), F.lit(False))
        state = nodes.agg(open_.alias("open"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total")).first()
        if not state["open"]:
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("component"))
        current = materialize(small_star(large_star(ends, nodes, state["total"]), state["total"]))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
