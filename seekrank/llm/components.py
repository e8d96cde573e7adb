"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekrank.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the least node of its neighbourhood (itself included).

    ``edges`` (a, b) with a > b. Large star moves the larger neighbours of every
    node, small star the smaller ones and the node itself.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = edges.unionByName(turned) if large else edges
    least = common.staged(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    if large:
        moved = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and checksums of the edge set; equal states mean equal sets but for a chance of 2**-128."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the least node of its component.

    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the components' size. Hubs are aggregated before the
    shuffle and written, so that Spark can split the join on a hub.
    """
    edges = common.staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = common.staged(_star(_star(edges, True), False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
