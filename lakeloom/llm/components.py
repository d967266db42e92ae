"""Distributed union-find over an edge table: alternating large-star and small-star rounds, DataFrame operations only.

Each round points every node to the least node it knows of; nothing of the graph comes to the driver. Minima are pre-aggregated
before their shuffle and the joins are plain equi-joins, which adaptive execution can split at a hot node. Every round is
checkpointed in the shared folder. Edges are two numbers, so a stage of a round has as many tasks as they need, not one for each
shuffle partition: rounds are many, and every task leaves a record on the driver and in the event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import checkpointed, tasks_for


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that joins two different nodes; root is the least node of its component.

    Edges may repeat, point either way or be loops; edges with a null end count for nothing. No edges: no rows.
    """
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    edges = checkpointed(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    n = edges.count()
    if n == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    known: tuple | None = None
    while True:
        # Stars make no more edges than there are edges and nodes.
        tasks = tasks_for(2 * n)
        edges = checkpointed(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks))
        # The rounds are over when all edges lead to roots, that is when no node is both an upper and a lower end, and nothing changed.
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        n = state[0]
        if state == known:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        known = state


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of each node are linked to its least neighbour (or to itself, if that is less)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them. Edges come with u > v and leave so."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).unionByName(least.select("u", F.col("m").alias("v")).coalesce(tasks)).distinct().coalesce(tasks)
