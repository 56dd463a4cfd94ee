"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """Each node of column u with the smallest among itself and its neighbours v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in columns ``a`` and ``b``; the smallest node names it.

    Large-star and small-star rounds: every round links neighbours to the smallest one
    they know, from above and then from below, until nothing changes. Minima are
    summed up before the shuffle and written before they are joined back: a join of two
    tables lets Spark split the edges of a node with very many neighbours, which a join
    with a grouping of its own key would not. Each round is a written table.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        # Large star: neighbours above a node go to the smallest node around it.
        least = written(_least(both), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        # Small star: a node and its neighbours below go to the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.where("u <> v").distinct(), "star")
        discard(before, least, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # All edges are now from a node to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
