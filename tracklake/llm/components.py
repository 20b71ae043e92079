"""Connected components of a link table by alternating large and small stars, a fixed number of shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed, hot_join


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node reachable.

    Rounds grow with the logarithm of the longest chain. Each round is checkpointed; the driver sees one row of
    figures a round. Minima are taken before the shuffle and nodes with very many links are met by a broadcast of
    bounded size, so such a node is no single task's work.
    Links to itself and nulls are left out; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    seen = None
    while True:
        edges = checkpointed(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        seen = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = hot_join(both, low.select("u", "m"), "u", low.select("u", "n"), total=2 * now[0]).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(least.select("a", F.col("m").alias("b"))).distinct()
