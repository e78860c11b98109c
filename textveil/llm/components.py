"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import KEY_ROWS, checkpointed, looked_up


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    """Twice the number of links, the largest number of links of a node, and the nodes that are neither centre nor leaf of a star."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    each = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    odd = F.when((F.col("up") == 0) | ((F.col("up") == 1) & (F.col("n") == 1)), 0).otherwise(1)
    return tuple(each.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("n"), F.sum(odd)))).first())


#: Rows of a link table that one task takes.
TASK_ROWS = 250_000


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of ``links(a, b)``; the component is its smallest node.

    Each round points every neighbour of a node at the smallest of them: minima by node, pre-aggregated,
    and a lookup of the node's minimum for each link. The nodes of very many links are looked up in a
    broadcast of bounded size (``looked_up``), so no task gets the links of a hub. Links
    that are loops, repeated or hold a null change nothing; no links give no rows. The tables shrink as
    rounds go on, and so do the tasks: there is one for ``TASK_ROWS`` rows, or for each core. It ends when
    all that is left are stars around their smallest nodes.
    """
    cores = links.sparkSession.sparkContext.defaultParallelism
    edges = checkpointed(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        total, most, odd = _state(edges)
        if not odd:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        tasks = max(cores, -(-total // (2 * TASK_ROWS)))
        if most <= KEY_ROWS:  # no node has many links, nor will have in this round's tables
            total = 0
        both = _both(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("key_rows")).withColumn("m", F.least("a", "m"))
        large = looked_up(both, least, "a", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("key_rows"))
        small = looked_up(large, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(least.select("a", F.col("m").alias("b")).union(small).distinct().coalesce(tasks))
    raise RuntimeError("components did not settle")
