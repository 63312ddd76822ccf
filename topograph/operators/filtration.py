"""Distances on bounded subgraphs under named filtrations, as numpy matrices inside grouped kernels and as long tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topograph.functions.lineage import cut_lineage
from topograph.operators.graph import weight
from topograph.schema import FILTRATIONS

#: Shortest length of an edge on a weighted path.
LEAST_LENGTH = 1e-6
INF = float("inf")


def check_filtration(name: str) -> str:
    if name not in (*FILTRATIONS, "binary"):
        raise ValueError(f"unknown filtration {name!r}; known: {', '.join(FILTRATIONS)}")
    return name


def floyd_warshall(lengths: np.ndarray) -> np.ndarray:
    """All shortest paths; inf where there is none."""
    d = lengths.copy()
    np.fill_diagonal(d, 0.0)
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def cap_unreachable(d: np.ndarray) -> np.ndarray:
    """Unreachable pairs are one further than the furthest reachable pair; 1 if none is reachable."""
    off = ~np.eye(len(d), dtype=bool)
    finite = d[off & np.isfinite(d)]
    return np.where(np.isfinite(d), d, finite.max() + 1 if len(finite) else 1.0)


def distance_matrix(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, filtration: str) -> np.ndarray:
    """i, j: ends of the edges; w: weights, nan where missing. Zero diagonal."""
    check_filtration(filtration)
    if not n:
        return np.zeros((0, 0))
    if filtration in ("correlation_distance", "binary"):
        similar = np.full((n, n), -np.inf)
        for x, y in ((i, j), (j, i)):
            np.maximum.at(similar, (x, y), 1.0 if filtration == "binary" else np.where(np.isnan(w), 1.0, w))  # of repeated edges the heaviest
        similar[np.isinf(similar)] = 0.0
        np.fill_diagonal(similar, 1.0)
        return 1.0 - similar
    length = np.ones(len(w)) if filtration == "hop_distance" else np.maximum(LEAST_LENGTH, 1.0 - np.nan_to_num(w))
    d = np.full((n, n), np.inf)
    apart = i != j
    for x, y in ((i, j), (j, i)):
        np.minimum.at(d, (x[apart], y[apart]), length[apart])  # of repeated edges the shortest
    return cap_unreachable(floyd_warshall(d))


def subgraph_matrix(rows: pd.DataFrame, filtration: str) -> tuple[list[str], np.ndarray]:
    """rows of one subgraph: members as (a = b = node, w null), edges as (a, b, w), marked by is_edge."""
    first, flags = rows["a"].to_numpy(), rows["is_edge"].to_numpy(bool)
    names = first[~flags].tolist()
    at = {n: k for k, n in enumerate(names)}
    i, j = (np.fromiter((at[x] for x in c[flags]), np.int64) for c in (first, rows["b"].to_numpy()))
    return names, distance_matrix(len(names), i, j, rows["w"].to_numpy(np.float64)[flags], filtration)


#: Subgraphs of at most so many members have their matrix made from plain lists.
LISTED_MEMBERS = 24


def listed_matrix(rows: list[tuple], filtration: str) -> tuple[list[str], np.ndarray | list[list[float]]]:
    """subgraph_matrix() of rows (a, b, w, is_edge, pos) as map_lists() gives them; the same distances, as rows of floats for a small subgraph."""
    names = [row[0] for row in rows if not row[3]]
    at, n = {name: k for k, name in enumerate(names)}, len(names)
    if n > LISTED_MEMBERS:
        ends = [(at[a], at[b], w) for a, b, w, is_edge, _ in rows if is_edge]
        i, j, w = (np.array(c) for c in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return names, distance_matrix(n, i, j, w.astype(np.float64), filtration)
    similar = filtration in ("correlation_distance", "binary")
    d = [[INF] * n for _ in range(n)]
    for k in range(n):
        d[k][k] = 0.0
    for a, b, w, is_edge, _ in rows:
        if is_edge and a != b:
            i, j = at[a], at[b]
            missing = w is None or w != w
            if filtration == "correlation_distance":
                far = 0.0 if missing else 1.0 - w
            elif filtration == "weighted_shortest_path":
                far = 1.0 if missing else max(LEAST_LENGTH, 1.0 - w)
            else:
                far = 0.0 if similar else 1.0
            if far < d[i][j]:  # of repeated edges the shortest
                d[i][j] = d[j][i] = far
    if similar:
        return names, [[1.0 if x == INF else x for x in row] for row in d]
    for k in range(n):
        via = d[k]
        for i in range(n):
            own = d[i]
            first = own[k]
            if first < INF and i != k:
                for j in range(n):
                    if first + via[j] < own[j]:
                        own[j] = first + via[j]
    furthest = max((x for i in range(n) for j, x in enumerate(d[i]) if j != i and x < INF), default=0.0)
    return names, [[x if x < INF else furthest + 1 for x in row] for row in d]


def with_members(edges: DataFrame, members: DataFrame, group: list[str], inside: DataFrame | None = None) -> DataFrame:
    """The rows that subgraph_matrix() reads: one per member (its pos decides the order), one per induced edge (inside, where they are known)."""
    from topograph.operators.graph import induced_edges

    pos = F.col("pos") if "pos" in members.columns else F.lit(0)
    if inside is None:
        inside = induced_edges(edges, members.select(*group, "node"), group)
    nodes = members.select(*group, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(None).cast("double").alias("w"), F.lit(False).alias("is_edge"), pos.cast("long").alias("pos"))
    return nodes.union(inside.select(*group, "a", "b", "w", F.lit(True).alias("is_edge"), F.lit(0).cast("long").alias("pos")))


def correlation_distance_stats(edges: DataFrame, members: DataFrame, group: list[str], repeated: bool = False) -> DataFrame:
    """Mean and population deviation over all n * n cells of 1 - adjacency, in closed form: no pair but the edges is built.

    repeated: a name stands for several nodes, so pairs repeat and an edge may be a loop. Then every row counts as a pair of its own.
    """
    from topograph.operators.graph import induced_edges

    inside = induced_edges(edges, members.select(*group, "node"), group)
    if not repeated:
        inside = inside.filter("a <> b")
    sums = inside.groupBy(*group).agg(F.sum(2 * (1 - weight(1.0))).alias("s1"), F.sum(2 * (1 - weight(1.0)) * (1 - weight(1.0))).alias("s2"), F.count(F.lit(1)).alias("m"))
    n = F.col("n").cast("double")
    far = n * (n - 1) - 2 * F.coalesce("m", F.lit(0))
    mean = (F.coalesce("s1", F.lit(0.0)) + far) / (n * n)
    square = (F.coalesce("s2", F.lit(0.0)) + far) / (n * n)
    rows = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(sums, group, "left")
    return rows.select(*group, "n", mean.alias("distance_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("distance_std"))


#: Groups of more members have their paths found by joins instead of a matrix in one task; both give the same distances.
MATRIX_MEMBERS = 256


def distances(edges: DataFrame, members: DataFrame, group: list[str], filtration: str) -> DataFrame:
    """Long form (group, i, j, d) with i < j by name; pairs that no path joins are one further than the group's furthest pair."""
    from topograph.operators.graph import induced_edges

    check_filtration(filtration)
    if filtration in ("correlation_distance", "binary"):
        far = F.lit(1.0) - (weight(1.0) if filtration == "correlation_distance" else F.lit(1.0))
        near = induced_edges(edges, members.select(*group, "node"), group).filter("a <> b").select(*group, F.col("a").alias("i"), F.col("b").alias("j"), far.alias("d"))
        return _pairs(members, group).join(near, [*group, "i", "j"], "left").select(*group, "i", "j", F.coalesce("d", F.lit(1.0)).alias("d"))
    length = F.lit(1.0) if filtration == "hop_distance" else F.greatest(F.lit(LEAST_LENGTH), 1.0 - weight(0.0))
    near = paths(edges, members, group, length)
    furthest = F.max("d").over(Window.partitionBy(*group))
    return _pairs(members, group).join(near, [*group, "i", "j"], "left").select(*group, "i", "j", F.coalesce("d", furthest + 1, F.lit(1.0)).alias("d"))


def _pairs(members: DataFrame, group: list[str]) -> DataFrame:
    """Pairs i < j of each group's members: the result's own rows."""
    one = lambda name: members.select(*group, F.col("node").alias(name)).distinct()
    return one("i").join(one("j"), group).filter("i < j")


def paths(edges: DataFrame, members: DataFrame, group: list[str], length: Column) -> DataFrame:
    """(group, i, j, d), i < j by name: the shortest paths inside each group's subgraph, where there is one. length: of an edge, from its w; above 0."""
    from topograph.operators.graph import induced_edges

    own = cut_lineage(members.select(*group, "node").distinct())
    large = own.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > MATRIX_MEMBERS).select(*group)
    lengths = cut_lineage(induced_edges(edges, own, group).filter("a <> b").select(*group, "a", "b", length.alias("w")))
    return _matrix_paths(lengths.join(large, group, "left_anti"), group).union(_table_paths(lengths.join(large, group, "left_semi"), group))


def _matrix_paths(lengths: DataFrame, group: list[str]) -> DataFrame:
    """Paths of bounded groups, a matrix each."""
    from topograph.functions.grouped import map_groups

    types = {f.name: f.dataType.simpleString() for f in lengths.schema.fields}

    def run(key: tuple, part: pd.DataFrame):
        a, b = part["a"].to_numpy(), part["b"].to_numpy()
        names = sorted({*a, *b})
        at = {n: k for k, n in enumerate(names)}
        i, j = (np.fromiter((at[x] for x in c), np.int64) for c in (a, b))
        d = np.full((len(names), len(names)), np.inf)
        for x, y in ((i, j), (j, i)):
            np.minimum.at(d, (x, y), part["w"].to_numpy())  # of repeated edges the shortest
        d = floyd_warshall(d)
        for x, y in zip(*np.nonzero(np.triu(np.isfinite(d), 1))):
            yield (*key, names[x], names[y], float(d[x, y]))

    return map_groups(lengths, group, run, ", ".join([f"{g} {types[g]}" for g in group] + ["i string, j string, d double"]))


def _table_paths(lengths: DataFrame, group: list[str]) -> DataFrame:
    """Paths of groups of any size: all sources at once, by frontiers.

    A row per source and node it reaches; a round sends the rows of the next bucket of distances, those at most a bucket's width above
    the group's nearest open row, over their edges, and keeps what is shorter. A bucket is as wide as the group's mean edge: short edges
    settle inside a bucket, and few rows are sent again. A round joins on (group, node) and shuffles by (group, source, node); nothing
    of a group meets in one task but the edges of a node.
    """
    links = cut_lineage(lengths.select(*group, F.col("a").alias("node"), F.col("b").alias("nbr"), "w").union(lengths.select(*group, F.col("b").alias("node"), F.col("a").alias("nbr"), "w")))
    width = cut_lineage(lengths.groupBy(*group).agg(F.avg("w").alias("width")))
    state = links.select(*group, F.col("node").alias("source"), "node").distinct().select(*group, "source", "node", F.lit(0.0).alias("d"), F.lit(True).alias("open"))
    state = cut_lineage(state)
    while True:
        nearest = state.filter("open").groupBy(*group).agg(F.min("d").alias("nearest")).join(width, group).select(*group, (F.col("nearest") + F.col("width")).alias("upto"))
        nearest = cut_lineage(nearest)  # a row a group
        if nearest.isEmpty():
            return state.filter("source < node").select(*group, F.col("source").alias("i"), F.col("node").alias("j"), "d")
        marked = state.join(nearest, group, "left").withColumn("sent", F.col("open") & (F.col("d") <= F.col("upto")))
        sent = marked.filter("sent").select(*group, "source", "node", "d").join(links, [*group, "node"])
        reached = sent.select(*group, "source", F.col("nbr").alias("node"), F.lit(None).cast("double").alias("old"), (F.col("d") + F.col("w")).alias("new"), F.lit(False).alias("waits"))
        known = marked.select(*group, "source", "node", F.col("d").alias("old"), F.lit(None).cast("double").alias("new"), (F.col("open") & ~F.coalesce("sent", F.lit(False))).alias("waits"))
        met = known.union(reached).groupBy(*group, "source", "node").agg(F.min("old").alias("old"), F.min("new").alias("new"), F.max("waits").alias("waits"))
        shorter = F.coalesce(F.col("new") < F.coalesce("old", F.lit(float("inf"))), F.lit(False))
        state = cut_lineage(met.select(*group, "source", "node", F.least("old", "new").alias("d"), (shorter | F.col("waits")).alias("open")), instead_of=state)


def infinite_adjacency(edges: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """Cells (group, a, b, w), a < b, of the adjacency of bounded subgraphs, with infinity where there is no edge."""
    from topograph.operators.graph import induced_edges

    one = lambda name: members.select(*group, F.col("node").alias(name))
    pairs = one("a").join(one("b"), group).filter("a < b")
    return pairs.join(induced_edges(edges, members, group), [*group, "a", "b"], "left").select(*group, "a", "b", F.coalesce("w", F.lit(float("inf"))).alias("w"))


def path_distances(edges: DataFrame, members: DataFrame, group: list[str], weighted: bool = True) -> DataFrame:
    """All-pairs shortest paths (group, i, j, d), i < j by name, of summed weights inside each group; infinity where there is none."""
    near = paths(edges, members, group, F.col("w") if weighted else F.lit(1.0))
    return _pairs(members, group).join(near, [*group, "i", "j"], "left").select(*group, "i", "j", F.coalesce("d", F.lit(float("inf"))).alias("d"))
