"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in (a, b), component being the smallest id reachable.

    Alternating large-star and small-star rounds: every node points its larger, then its
    smaller neighbours to the smallest one, until the links are stars. Minima are taken
    before the shuffle and joined back, so no node's neighbours are gathered; a node with very
    many is a skewed key of a plain join, which adaptive execution splits (an exchange follows it).
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    was = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if state[0] == 0 or state == was:
            break
        was = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(down.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
