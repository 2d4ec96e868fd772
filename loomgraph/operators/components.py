"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return linked.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).filter("src <> dst").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge in ``edges`` (src, dst); the component is its least node.

    The steps keep connectivity and turn every component into a star around its least node in a number of rounds
    that grows with the logarithm of its size. Each round is materialised, so a lost executor costs one round.
    Self-loops, repeated and doubly oriented edges change nothing; edges with a null end are ignored.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head())
        if now == seen:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def all_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of every node; one without an edge is a component by itself."""
    found = components(edges).withColumnRenamed("node", "__node")
    return nodes.select("node").distinct().join(found, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("component", "node").alias("component"))


def fragments(edges: DataFrame, comms: DataFrame) -> DataFrame:
    """(node, comm, component, fragmented): components inside each community of ``comms`` (node, comm).

    All nodes outside their community's largest component are fragmented; of several largest ones the one with the
    least node counts as whole.
    """
    a, b = comms.select(F.col("node").alias("src"), F.col("comm").alias("a")), comms.select(F.col("node").alias("dst"), F.col("comm").alias("b"))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")
    placed = cut(comms.select("node", "comm").join(all_components(inner, comms), "node"), "fragments")
    sizes = placed.groupBy("comm", "component").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("comm").agg(F.max(F.struct("n", (-F.col("component")).alias("least"))).alias("m")).select("comm", (-F.col("m.least")).alias("whole"))
    return placed.join(whole, "comm").select("node", "comm", "component", (F.col("component") != F.col("whole")).alias("fragmented"))
