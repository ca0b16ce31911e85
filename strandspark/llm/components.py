"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours to the least of its neighbourhood.

    The large star sends the greater neighbours, the small star the smaller ones and
    the node itself. Both keep the components. The minimum is combined map-side and
    written, so both sides of the join back are plain shuffles, which Spark splits
    where a node has very many neighbours.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not small:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    least = written(least, "least")
    sent = both.join(least, "u")
    if small:
        out = sent.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = sent.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def least_of_component(edges: DataFrame) -> DataFrame:
    """``node`` and ``least``, the smallest node of its component, for every node with an edge.

    ``edges`` has a and b, of one ordered type; loops, repeats and both directions
    are fine, nulls are left out. Each round is written to the shared folder, which
    cuts the lineage; the rounds end when a large star changes nothing, after a
    number that grows with the logarithm of the graph. An empty list gives no rows.
    """
    edges = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    held = None
    while True:
        edges = written(_star(_star(edges, small=False), small=True), "star")
        # of a forest of stars nothing moves: count and order-free sum of the edges stay
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == held:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())
        held = tuple(state)
