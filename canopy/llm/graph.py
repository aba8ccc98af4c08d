"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join and an aggregation over stored tables; labels and links never reach
the driver (which reads only the two counts that end the loop), and hubs are looked up skew-safely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import lookup, shared_table


def _lowest(edges: DataFrame) -> DataFrame:
    """(hi, low, n): the smallest lower neighbour of each node that has one, and its number of lower neighbours."""
    return shared_table(edges.groupBy("hi").agg(F.min("lo").alias("low"), F.count("*").alias("n")), "stars")


def _large_star(edges: DataFrame, lowest: DataFrame, total: int) -> DataFrame:
    """Every node above u moves from u to the smallest node around u."""
    # Roots, which have no lower node, are the usual hubs.
    hubs = edges.groupBy("lo").agg(F.count("*").alias("uses")).join(lowest.select(F.col("hi").alias("lo"), "low"), "lo", "left")
    found = lookup(edges, shared_table(hubs, "hubs"), ["lo"], "uses", total, [F.col("hi")])
    return found.select("hi", F.coalesce("low", "lo").alias("lo")).distinct()


def _small_star(edges: DataFrame, lowest: DataFrame, total: int) -> DataFrame:
    """A node and its lower neighbours all move to the smallest of them."""
    found = lookup(edges, lowest, ["hi"], "n", total, [F.col("lo")])
    moved = found.where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return moved.unionByName(found.select("hi", F.col("low").alias("lo"))).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of edges(a, b), component being the smallest node reachable.

    Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = shared_table(edges, "edges")
    for _ in range(max_rounds):
        lowest = _lowest(edges)
        total = edges.count()
        links = edges.select("lo").distinct().join(lowest.select(F.col("hi").alias("lo")), "lo", "left_semi")
        if lowest.count() == total and links.limit(1).count() == 0:
            nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return nodes.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        edges = shared_table(_large_star(edges, lowest, total), "edges")
        edges = shared_table(_small_star(edges, _lowest(edges), edges.count()), "edges")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
