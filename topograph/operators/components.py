"""Connected components of many graphs at once, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.functions.lineage import cut_lineage


def _large_star(links: DataFrame, group: list[str]) -> DataFrame:
    """Each node hangs its larger neighbours on the least of itself and its neighbours."""
    both = links.select(*group, F.col("id").alias("u"), F.col("root").alias("v")).union(links.select(*group, F.col("root").alias("u"), F.col("id").alias("v")))
    least = both.groupBy(*group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u")).join(least, [*group, "u"])
    return larger.select(*group, F.col("v").alias("id"), F.col("m").alias("root")).distinct()


def _small_star(links: DataFrame, group: list[str]) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the least of them."""
    least = links.groupBy(*group, "id").agg(F.min("root").alias("m"))
    hung = links.join(least, [*group, "id"]).select(*group, F.col("root").alias("id"), F.col("m").alias("root"))
    return hung.union(least.select(*group, "id", F.col("m").alias("root"))).filter("id <> root").distinct()


def components(links: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """links: group, id, other; nodes: group, id. A row (group, id, root), root the smallest id of its component.

    Links are rehung in turns, on the least neighbour of both ends (large star) and of the smaller end (small star),
    until all of a component hang on its smallest id; their number never grows, and a path shrinks to a fraction in each turn, so
    rounds grow with the logarithm of a component's size, not with its diameter. Sums of a node are combined before the shuffle,
    and a node with a third of all links is only ever joined to one row.
    """
    now = cut_lineage(links.filter("id <> other").select(*group, F.greatest("id", "other").alias("id"), F.least("id", "other").alias("root")).distinct())
    while True:
        turned = cut_lineage(_small_star(_large_star(now, group), group), instead_of=now)
        # hung: all ids hang on one root, which hangs on none
        stars = turned.groupBy(*group, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        if stars and turned.join(turned.select(*group, F.col("id").alias("root")), [*group, "root"], "left_semi").isEmpty():
            break
        now = turned
    hung = turned.select(*group, "id", "root")
    return nodes.select(*group, "id").join(hung, [*group, "id"], "left").select(*group, "id", F.coalesce("root", "id").alias("root"))


#: Subgraphs of at most so many members are walked through in one pass, larger ones contracted by joins; both give the same numbers.
WALKED_MEMBERS = 64


def subgraph_components(edges: DataFrame, members: DataFrame, group: list[str], inside: DataFrame | None = None) -> DataFrame:
    """Components of each group's induced subgraph: group, n_components. inside: the induced edges, where they are known."""
    from topograph.functions.grouped import map_lists
    from topograph.operators.graph import induced_edges

    nodes = cut_lineage(members.select(*group, F.col("node").alias("id")).distinct())
    links = (induced_edges(edges, members, group) if inside is None else inside).select(*group, F.col("a").alias("id"), F.col("b").alias("other"))
    large = cut_lineage(nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > WALKED_MEMBERS).select(*group))
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    none = large.isEmpty()
    if not none:
        links = cut_lineage(links)

    def walk(key: tuple, rows: list[tuple]):
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        joined = 0
        for a, b in rows:
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                joined += 1
        yield (*key, len(parent) - joined)

    own = nodes.select(*group, "id", F.col("id").alias("other")).union(links)
    walked = map_lists(own if none else own.join(large, group, "left_anti"), group, walk, ", ".join([*(f"{g} {types[g]}" for g in group), "n_components long"]))
    if none:
        return walked
    found = components(links.join(large, group, "left_semi"), nodes.join(large, group, "left_semi"), group)
    return walked.union(found.groupBy(*group).agg(F.count_if(F.col("id") == F.col("root")).alias("n_components")))
