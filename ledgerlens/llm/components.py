"""Connected components of an edge table, in Spark (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of every node, itself included (pre-aggregated)."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's lowest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_lowest(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the lowest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (u, v: long) with the smallest node they reach.

    Returns (node, component), one row per node that has an edge; self-loops
    and rows with a null end are ignored, repeated edges count once, and an
    empty table gives no rows.  Each pass is two grouped joins written to the
    shared checkpoint folder; the passes end when every node hangs on its
    root, after about log(nodes) of them.
    """
    edges = edges.select("u", "v").where("u <> v")
    nodes = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        # a star forest: no node is both a root and a leaf, no leaf has two roots
        seen = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("leaves")).first()
        roots = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if seen["n"] == seen["leaves"] and roots.isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
