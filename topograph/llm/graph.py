"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Links the neighbours of each u (larger ones, or u and smaller ones) to the smallest of u and its neighbours.

    The smallest neighbour is pre-aggregated and written, so that the join back has two plain sides, of which Spark can
    split the one with a hub's rows.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        kept = both.filter("v > u")
        out = kept.join(materialize(least, "star"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.filter("v < u")
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "star")
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v (long). A row (u, v) for each node but the smallest of its component, v being the smallest."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return now
        state = mark
        now = materialize(_star(materialize(_star(now, True), "large"), False), "small")
