"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.steps import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges ``(a, b)`` with ``b < a``.

    The smallest neighbour comes from an aggregate that combines map-side; the
    join back meets one row per node, so a hub with very many links is split by
    the adaptive skew join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    large = (both.join(low, "a").where(F.col("b") > F.col("a"))
             .select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a > b").distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return small.where("a > b").unionByName(own).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for every node with a link to another node.

    The component is the smallest node reachable. Nodes are longs; null nodes and
    links of a node to itself count for nothing; no links give no rows. Each round
    is written to the shared folder; rounds grow with the logarithm of the longest
    chain, and stars need one.
    """
    edges = materialize(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where("a > b").distinct(), "links")
    while True:
        # finished when every node points to one node that points nowhere itself
        state = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k")).first()
        if state.n == state.k and edges.select(F.col("b").alias("a")).distinct().join(
                edges, "a", "left_semi").isEmpty():
            break
        edges = materialize(_stars(edges), "links")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
