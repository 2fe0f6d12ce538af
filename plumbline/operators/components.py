"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import removed, stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for ``nodes`` (id) and ``edges`` (a, b); the component
    is its smallest id. Rounds grow with the logarithm of the graph."""
    links = edges.filter("a != b").select("a", "b").distinct()
    links = stored(links)
    while True:
        # Large star: link every larger neighbour to the smallest one around.
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: link the smaller neighbours of a node, and itself, to the smallest. The links lead downwards already.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = (moved.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        old, links = links, stored(small)
        removed(old)
        # Done when all links are stars: a further round would return the same ones.
        ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(
            links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top")).agg(F.max((F.col("up") + F.col("top") > 1) & (F.col("up") > 0))).first()[0]:
            break
    return nodes.join(links.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", F.col("id")).alias("component"))
