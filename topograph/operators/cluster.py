"""Density clustering and neighbour distances of plane points, found through a grid rather than all pairs.

Points that stand at one place are one place with a count, so copies make no pairs; places meet only the cells around
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topograph.functions.lineage import cut_lineage


def _far() -> Column:
    return F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))


def places(points: DataFrame, group: list[str]) -> DataFrame:
    """points: group columns, id, x, y. group, x, y, n, first (the smallest id there)."""
    return points.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def _around(rings: int) -> Column:
    steps = range(-rings, rings + 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])


def close_places(spots: DataFrame, group: list[str], eps: float) -> DataFrame:
    """spots as places() gives them. Pairs (first, other, m) within eps, both ways and with itself, m the count at the other; cells of side eps meet their neighbours only."""
    cell = lambda c: F.floor(F.col(c) / eps)
    home = spots.select(*group, F.col("first").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("m"), cell("x").alias("cx"), cell("y").alias("cy"))
    reach = spots.withColumn("d", F.explode(_around(1))).select(*group, "first", "x", "y", (cell("x") + F.col("d.i")).alias("cx"), (cell("y") + F.col("d.j")).alias("cy"))
    return reach.join(home, [*group, "cx", "cy"]).filter(_far() <= eps).select(*group, "first", "other", "m")


def dbscan(points: DataFrame, group: list[str], eps: float, min_samples: int = 5) -> DataFrame:
    """group, id, label: clusters numbered by their smallest core point, -1 for noise; border points join their smallest core cluster."""
    from topograph.operators.components import components

    spots = cut_lineage(places(points, group))
    pairs = cut_lineage(close_places(spots, group, eps))
    core = cut_lineage(pairs.groupBy(*group, "first").agg(F.sum("m").alias("n")).filter(F.col("n") >= min_samples).select(*group, F.col("first").alias("id")))
    links = pairs.select(*group, F.col("first").alias("id"), "other").filter("id <> other")
    links = links.join(core, [*group, "id"], "left_semi").join(core.withColumnRenamed("id", "other"), [*group, "other"], "left_semi")
    roots = components(links, core, group)
    numbered = roots.select(*group, "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*group).orderBy("root")) - 1)
    labelled = cut_lineage(roots.join(numbered, [*group, "root"]).select(*group, "id", "label"))
    border = pairs.join(labelled.withColumnRenamed("id", "other"), [*group, "other"]).groupBy(*group, "first").agg(F.min("label").alias("border"))
    own = labelled.withColumnsRenamed({"id": "first", "label": "own"})
    found = spots.join(own, [*group, "first"], "left").join(border, [*group, "first"], "left").select(*group, "x", "y", F.coalesce("own", "border", F.lit(-1)).alias("label"))
    return points.select(*group, "id", "x", "y").join(found, [*group, "x", "y"]).select(*group, "id", "label")


#: Halvings of a group's range; float32 values that differ are told apart.
LEVELS = 24


def knn_distance(points: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """Distance of each point to its k-th neighbour among its own group's points (the point itself is number 0); no row where the group has no k others.

    A group's range is halved again and again. A place searches at the finest level whose cell around it still holds more
    than k points: its k-th neighbour is then at most a cell's diagonal away, so it stands in the 5 x 5 cells around. Of
    the places of one cell at most 4 k search at its level, so no point is met by more than 100 k of them a level, however
    unevenly points are spread.
    """
    spots = places(points, group)
    span = spots.groupBy(*group).agg(F.sum("n").alias("total"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("width"))
    spots = cut_lineage(spots.join(span.filter(F.col("total") > k), group).drop("first", "total"))
    alone = spots.filter(F.col("n") > k).select(*group, "x", "y", F.lit(0.0).alias("d"))
    cells = F.expr("shiftleft(1L, level)")
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / (F.col("width") / cells)), cells - 1)
    levelled = spots.filter("width > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).select(*group, "x", "y", "n", "level", cell("x").alias("cx"), cell("y").alias("cy"))
    crowded = levelled.groupBy(*group, "level", "cx", "cy").agg(F.sum("n").alias("held")).filter(F.col("held") > k)
    finest = levelled.filter(F.col("n") <= k).join(crowded, [*group, "level", "cx", "cy"]).groupBy(*group, "x", "y").agg(F.max_by(F.struct("level", "cx", "cy"), "level").alias("own"))
    asked = finest.withColumn("at", F.explode(_around(2))).select(*group, "x", "y", "own.level", (F.col("own.cx") + F.col("at.i")).alias("cx"), (F.col("own.cy") + F.col("at.j")).alias("cy"))
    there = levelled.withColumnsRenamed({"x": "ox", "y": "oy"})
    met = asked.join(there, [*group, "level", "cx", "cy"]).select(*group, "x", "y", _far().alias("d"), "n")
    upto = F.sum("n").over(Window.partitionBy(*group, "x", "y").orderBy("d"))  # of points, itself included
    kth = met.withColumn("upto", upto).filter(F.col("upto") > k).groupBy(*group, "x", "y").agg(F.min("d").alias("d"))
    return points.select(*group, "id", "x", "y").join(alone.union(kth), [*group, "x", "y"]).select(*group, "id", F.col("d").alias("kth_distance"))


def cluster_members(labels: DataFrame, group: list[str]) -> DataFrame:
    """group, label, members: the ids of each cluster in order, without noise. labels: group columns, id, label, as dbscan() gives them."""
    return labels.filter("label >= 0").groupBy(*group, "label").agg(F.sort_array(F.collect_list("id")).alias("members"))
