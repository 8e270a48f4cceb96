"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is joins and partial minima, so a hub with many links is no larger task than any other; the edge table is
written to the shared folder after each round. Rounds grow with the logarithm of the longest chain.

Cases: a link with a null end, or of a node with itself, is none; repeated links count once; without links there is no
node. Nodes that no link names aren't given back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every neighbour that is larger (large-star) or no larger (small-star) at the least of them all."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in links (a, b); the component is its smallest node."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")  # both skip nulls, which leaves one end twice
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        following = scratch.save(_star(_star(edges, large=True), large=False), "edges")
        scratch.drop(edges)
        edges = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
