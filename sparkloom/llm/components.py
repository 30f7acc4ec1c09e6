"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, afresh


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being its component's least node.

    Each round moves neighbours to the least neighbour, first the larger ones, then the smaller ones, until
    nothing changes; only sums go to the driver. A hub's edges are split by AQE, as the other side comes afresh. Self-loops and repeated edges are allowed; no edges give no rows."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    old, state = None, None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(afresh(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(afresh(least, "u"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        now = work.table(small)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if old is not None:
            work.drop(old)
        if new == state:
            break
        old, state = now, new
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
