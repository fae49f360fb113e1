"""Connected components of a link table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugesieve.functions.storage import sized_broadcast, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(_looked_up(least), "a").filter("b <> m").select(
        F.col("m").alias("a"), F.col("b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the smallest of them."""
    least = _looked_up(edges.groupBy("b").agg(F.min("a").alias("m")))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b"))


def _looked_up(least: DataFrame) -> DataFrame:
    """One row per node, stored: a small table is broadcast, and beyond that both sides of the join are plain exchanges, so
    that the links of a hot node can be split over tasks."""
    return sized_broadcast(stored(least, "least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    ``edges`` has two number columns ``a`` and ``b``. Each round halves the distances at least, keeps at most one
    row per link and needs only minima per node, which combine before the shuffle. A row whose ends are equal or
    null links nothing; repeated and reversed rows count once. Nodes without a link are not returned.
    """
    pair = F.array_sort(F.array("a", "b"))
    edges = stored(edges.filter("a <> b").select(pair[0].alias("a"), pair[1].alias("b")).distinct(), "edges")
    seen = None
    while True:
        edges = stored(_small_star(_large_star(edges)).distinct(), "edges")
        # The star form is reached when the edges no longer change: their number and digest repeat.
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
