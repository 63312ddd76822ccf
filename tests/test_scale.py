"""Operators that must hold on large or uneven groups, against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from topograph.operators import cluster, components, filtration, homology, neighborhood


def component_roots(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    links, nodes = [], []
    for g, (n, m) in enumerate([(1, 0), (2, 1), (40, 20), (40, 60), (60, 30), (30, 200)]):
        nodes += [(g, i) for i in range(n)]
        links += [(g, r.randrange(n), r.randrange(n)) for _ in range(m)]
    links += [(2, 3, 3), (9, 1, 2)]  # a loop; a group without nodes
    got = components.components(spark.createDataFrame(links, "g long, id long, other long"), spark.createDataFrame(nodes, "g long, id long"), ["g"]).collect()
    for g in range(6):
        own = [x for k, x in nodes if k == g]
        assert {x["id"]: x["root"] for x in got if x["g"] == g} == component_roots([(a, b) for k, a, b in links if k == g], own)
    assert len(got) == len(nodes)
    none = components.components(spark.createDataFrame([], "g long, id long, other long"), spark.createDataFrame([(1, 5)], "g long, id long"), ["g"])
    assert [tuple(x) for x in none.collect()] == [(1, 5, 5)]


def test_components_of_a_long_path_in_few_rounds(spark, monkeypatch):
    """100,000 nodes in a row, in an order that helps nobody, beside a star."""
    rounds, real = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda *a: rounds.append(1) or real(*a))
    n = 100_000
    shuffled = (F.col("id") * 48271 % n).alias("id"), ((F.col("id") + 1) * 48271 % n).alias("other")
    path = spark.range(n - 1).select(F.lit("path").alias("g"), *shuffled)
    star = spark.range(1, 20_000).select(F.lit("star").alias("g"), F.lit(20_000).cast("long").alias("id"), F.col("id").alias("other"))
    nodes = spark.range(n).select(F.lit("path").alias("g"), "id").union(spark.range(1, 20_001).select(F.lit("star").alias("g"), "id"))
    got = components.components(path.union(star), nodes, ["g"]).groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("id").alias("n"))
    assert {tuple(x) for x in got.collect()} == {("path", 0, 0, n), ("star", 1, 1, 20_000)}
    assert len(rounds) <= 2 * math.log2(n)


def plane_points():
    r = random.Random(3)
    out = [("copies", i, 1.0, 2.0) for i in range(9)] + [("few", i, float(i), 0.0) for i in range(3)] + [("pair", 0, 0.0, 0.0), ("pair", 1, 5.0, 5.0), ("pair", 2, 5.0, 5.0), ("pair", 3, 0.0, 0.0)]
    out += [("even", i, r.random(), r.random()) for i in range(150)]
    out += [("ties", i, float(r.randrange(6)), float(r.randrange(6))) for i in range(120)]
    out += [("uneven", i, r.gauss(0, 1e-4), r.gauss(0, 1e-4)) for i in range(120)] + [("uneven", 200 + i, r.random() * 100, r.random() * 100) for i in range(20)]
    out += [("line", i, 0.0, 2.0 ** -(i % 30)) for i in range(60)]
    return out


def test_neighbour_distances_without_all_pairs(spark):
    points = plane_points()
    got = cluster.knn_distance(spark.createDataFrame(points, "g string, id long, x double, y double"), ["g"], 3).collect()
    groups = {g: [p for p in points if p[0] == g] for g, *_ in points}
    expected = {(g, i): sorted(math.dist((x, y), q[2:]) for q in groups[g])[3] for g, i, x, y in points if len(groups[g]) > 3}
    assert {(r["g"], r["id"]): pytest.approx(r["kth_distance"], abs=1e-12) for r in got} == expected


def density_labels(points, eps, least):
    near = {p[1]: [q[1] for q in points if math.dist(p[2:], q[2:]) <= eps] for p in points}
    core = [i for i, n in near.items() if len(n) >= least]
    roots = component_roots([(i, j) for i in core for j in near[i] if len(near[j]) >= least], core)
    label = {root: k for k, root in enumerate(sorted(set(roots.values())))}
    return {i: label[roots[i]] if i in roots else min((label[roots[j]] for j in near[i] if j in roots), default=-1) for i in near}


@pytest.mark.parametrize("eps", [0.15, 1.0])
def test_density_clusters(spark, eps):
    points = plane_points()
    got = cluster.dbscan(spark.createDataFrame(points, "g string, id long, x double, y double"), ["g"], eps, 5).collect()
    for g in {p[0] for p in points}:
        assert {r["id"]: r["label"] for r in got if r["g"] == g} == density_labels([p for p in points if p[0] == g], eps, 5), g
    assert len(got) == len(points)


def grown(edges, seed, cap):
    strength, near = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            strength[x] = strength.get(x, 0) + (1.0 if w is None else w)
            if a != b:
                near.setdefault(x, {})[y] = w or 0.0
    chosen = [seed]
    while len(chosen) < cap:
        frontier = {v: max(near[u][v] for u in chosen if v in near.get(u, {})) for u in chosen for v in near.get(u, {}) if v not in chosen}
        if not frontier:
            break
        chosen.append(max(frontier, key=lambda v: (frontier[v], round(strength[v], 9), v)))
    return chosen


@pytest.mark.parametrize("cap", [1, 2, 5, 25])
def test_seed_expansion_is_greedy(spark, cap, monkeypatch):
    r = random.Random(cap)
    nodes = [f"n{i:02d}" for i in range(40)]
    pairs = [p for p in itertools.combinations(nodes, 2) if r.random() < 0.12]
    edges = [(a, b, r.choice([None, 0.0, 0.25, 0.5, 0.5, 1.0])) for a, b in pairs] + [("n00", "n00", 1.0), ("only", "only", 1.0)]
    edges += [(f"p{i}", f"p{i + 1}", 0.5) for i in range(9)]  # a path: one node a round
    seeds = [*{x for e in edges for x in e[:2]}]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    monkeypatch.setattr(neighborhood, "ASKED", 2 if cap == 5 else 8)
    got = neighborhood.seed_expansion(df, spark.createDataFrame([(s,) for s in seeds], "seed string"), cap).collect()
    for s in seeds:
        own = sorted((x["rank"], x["node"]) for x in got if x["seed"] == s)
        assert own == list(enumerate(grown(edges, s, cap))), s


@pytest.mark.parametrize("method", ["hop_distance", "weighted_shortest_path"])
def test_paths_of_large_groups_are_those_of_the_matrix(spark, method, monkeypatch):
    r = random.Random(7)
    edges, members = [], []
    for g, (n, m) in enumerate([(1, 0), (2, 0), (5, 4), (30, 40), (60, 80)]):
        members += [(g, f"v{g}_{i}") for i in range(n)]
        edges += [(f"v{g}_{a}", f"v{g}_{b}", r.choice([None, 0.0, 0.3, 0.9, 0.97, 1.0])) for a, b in {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}]
    edges += [(f"v3_{i}", f"v3_{i + 1}", 0.97) for i in range(29)]  # a long way of short edges
    unique = {tuple(sorted(e[:2])): (*sorted(e[:2]), e[2]) for e in edges}
    df = spark.createDataFrame(list(unique.values()), "a string, b string, w double")
    groups = spark.createDataFrame(members, "g long, node string")
    own = lambda: {(x["g"], x["i"], x["j"]): x["d"] for x in filtration.distances(df, groups, ["g"], method).collect()}
    small = own()
    monkeypatch.setattr(filtration, "MATRIX_MEMBERS", 3)
    large = own()
    assert small.keys() == large.keys() and len(small) == 1 + 10 + 435 + 1770
    assert all(small[k] == pytest.approx(large[k], abs=1e-9) for k in small)
    for x, y, d in ((0, 29, None), (3, 7, None)):
        assert small[(3, *sorted((f"v3_{x}", f"v3_{y}")))] == pytest.approx(nearest(unique, 3, x, y, method), abs=1e-9), d


def nearest(edges, g, x, y, method):
    """One pair by repeated relaxation."""
    far = {f"v{g}_{x}": 0.0}
    for _ in range(40):
        for a, b, w in edges.values():
            step = 1.0 if method == "hop_distance" else max(1e-6, 1 - (w or 0.0))
            for u, v in ((a, b), (b, a)):
                if u in far and far[u] + step < far.get(v, math.inf):
                    far[v] = far[u] + step
    return far[f"v{g}_{y}"]


def test_kernel_grids_are_sums_of_gaussians(spark):
    r = random.Random(5)
    bars = [("a", 1, r.random() / 2, r.random() / 2 + 0.5) for _ in range(50)] + [("a", 1, 0.25, 0.75)] * 20 + [("b", 1, 0.1, math.inf), ("b", 0, 0.0, 0.5)]
    df = spark.createDataFrame(bars, "g string, dim int, birth double, death double").repartition(7)
    at = lambda i: i / 8
    bump = lambda x, y: math.exp(-(x * x + y * y) / (2 * 0.2**2)) / (2 * math.pi * 0.2**2)
    image = {(x["g"], x["px"], x["py"]): x["value"] for x in homology.persistence_image(df, ["g"], 1, 0.2, 9).collect()}
    heavy = {(x["g"], x["px"], x["py"]): x["value"] for x in homology.persistence_image(df, ["g"], 1, 0.2, 9, weight=F.col("life") + 1).collect()}
    thick = {(x["g"], x["px"], x["py"]): x["value"] for x in homology.persistence_density(df, ["g"], 1, 0.2, 9).collect()}
    for g in "ab":
        own = [(b, min(d, 1.0) - b) for k, dim, b, d in bars if k == g and dim == 1]
        finite = [(b, d) for k, dim, b, d in bars if k == g and dim == 1 and d < math.inf]
        for i in range(9):
            for j in range(9):
                assert image[g, i, j] == pytest.approx(sum(life * life * bump(at(i) - b, at(j) - life) for b, life in own))
                assert heavy[g, i, j] == pytest.approx(sum((life + 1) * bump(at(i) - b, at(j) - life) for b, life in own))
                if finite:
                    assert thick[g, i, j] == pytest.approx(sum(bump(at(i) - b, at(j) - d) for b, d in finite) / len(finite))
    assert len(image) == 162 and len(thick) == 81


def test_simplex_tree_of_any_dimension(spark):
    r = random.Random(9)
    edges = [("g", a, b, round(r.random(), 3)) for a, b in itertools.combinations([f"n{i}" for i in range(9)], 2) if r.random() < 0.8] + [("h", "x", "y", None)]
    d = {frozenset(e[1:3]): 1 - (1.0 if e[3] is None else e[3]) for e in edges}
    df = spark.createDataFrame(edges, "g string, a string, b string, w double")
    tree = homology.simplex_tree(df, ["g"], 5)
    got = {(x["g"], tuple(x["vertices"])): (x["dim"], x["value"]) for x in tree.collect()}
    expected = {("h", ("x",)): (0, 0.0), ("h", ("y",)): (0, 0.0), ("h", ("x", "y")): (1, 0.0)}
    for k in range(1, 7):
        for v in itertools.combinations([f"n{i}" for i in range(9)], k):
            if all(frozenset(p) in d for p in itertools.combinations(v, 2)):
                expected["g", v] = (k - 1, max([d[frozenset(p)] for p in itertools.combinations(v, 2)], default=0.0))
    assert got == expected and max(x[0] for x in got.values()) >= 4
    up = {(x["g"], tuple(x["vertices"]), tuple(x["coface"])) for x in homology.cofaces(tree, ["g"]).collect()}
    assert up == {(g, v[:i] + v[i + 1 :], v) for g, v in expected for i in range(len(v)) if len(v) > 1}


def _star(spark, folder, parts):
    """Orders of given parts; all are finished."""
    lines = [(k, p, 0.01 * (1 + (k + p) % 9)) for k, own in enumerate(parts) for p in own]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, "F") for k in range(len(parts))], "o_orderkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_edges_come_from_more_tasks_of_larger_tables(spark, tmp_path, monkeypatch):
    from topograph.sources import star_schema

    folder = _star(spark, tmp_path, [(k, k + 1, k + 2) for k in range(40)])
    whole = sorted(map(tuple, star_schema.edges(spark, folder).collect()))
    monkeypatch.setattr(star_schema, "TASK_LINES", 10)
    dealt = star_schema.edges(spark, folder)
    assert dealt.rdd.getNumPartitions() == 13  # 120 lines
    assert sorted(map(tuple, dealt.collect())) == whole


def test_edge_lists_tell_parts_of_seven_digits_apart(spark, tmp_path):
    import duckdb

    import __spark_entry__ as driver

    folder = _star(spark, tmp_path, [(999_998, 1_000_000), (999_998, 1_000_001), (100_000, 1_000_005), (100_000, 100_001), (1_000_000, 1_000_010)])
    db = duckdb.connect()
    for name in ("lineitem", "orders"):
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    for name in ("ppi_edges", "edge_file_scan", "pair_file_scan"):
        rows = driver.queries()[name](spark, folder)
        got = sorted(map(tuple, rows.collect()))
        assert got == sorted(db.execute(f"select {', '.join(rows.columns)} from ({driver.oracle_sql()[name]})").fetchall()), name


def test_neighbours_of_repeated_edges(spark):
    from topograph.operators import sets

    rows = spark.createDataFrame([("A", "B", 0.5), ("A", "B", 0.7), ("A", "C", 0.1)], "a string, b string, w double")
    members = spark.createDataFrame([("A",), ("B",)], "node string")
    assert [tuple(x) for x in sets.neighbours_within(rows, members).collect()] == [("A", ["B", "B"])]


def test_filled_seeds_look_no_further(spark, monkeypatch):
    from topograph.operators import neighborhood

    rng = random.Random(5)
    pairs = {(f"n{i:02d}", f"n{j:02d}"): rng.randint(1, 9) / 10 for i in range(40) for j in range(i + 1, 40) if rng.random() < (0.5 if i < 12 and j < 12 else 0.04)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a string, b string, w double")
    near = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    seeds = spark.createDataFrame([(n,) for n in near], "seed string")
    cap, sizes, cut = 6, [], neighborhood.cut_lineage
    monkeypatch.setattr(neighborhood, "cut_lineage", lambda df: sizes.append(cut(df)) or sizes[-1])
    strength = {n: round(sum(links.values()), 9) for n, links in near.items()}
    want = set()
    for seed in near:
        shell, seen, out = {seed}, {seed}, []
        for hop in (1, 2, 3):
            best = {}
            for n in shell:
                for m, w in near[n].items():
                    if m not in seen:
                        best[m] = max(best.get(m, 0.0), w)
            out += sorted(best, key=lambda m: (-best[m], -strength[m], m))
            shell, seen = set(best), seen | set(best)
        want |= {(seed, n, k) for k, n in enumerate([seed, *out][:cap])}
    assert {tuple(x) for x in neighborhood.ego_capped(edges, seeds, cap, 3).collect()} == want
    assert [x.count() <= (cap - 1) * len(near) for x in sizes] == [True, True]  # what is kept of the shells


def test_cosines_by_blocks(spark, monkeypatch):
    from topograph.operators import ranking

    rng = random.Random(6)
    rows = [(k % 3, k, [rng.gauss(0, 1) for _ in range(5)] if k % 11 else [0.0] * 5) for k in range(90)] + [(2, 90, None), (4, 91, [1.0] * 5)]
    monkeypatch.setattr(ranking, "BLOCK", 20)
    monkeypatch.setattr(ranking, "STRIP", 7)
    got = {tuple(x)[:3]: x["cosine"] for x in ranking.cosines(spark.createDataFrame(rows, "label int, id long, v array<double>"), "label").collect()}
    want = {}
    for g, i, v in rows:
        for h, j, o in rows:
            if g == h and i < j:
                size = math.hypot(*(v or [0])) * math.hypot(*(o or [0]))
                want[g, i, j] = sum(map(float.__mul__, v, o)) / size if size else 0.0
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


#: Rows of a graph whose names stand for several nodes: repeats, a turned pair, loops.
REPEATED = [("a", "b", 0.5), ("a", "b", 0.7), ("b", "c", 0.4), ("a", "c", 0.9), ("d", "c", 0.3), ("b", "d", 0.2), ("d", "b", 0.6), ("a", "d", 0.8), ("c", "c", 0.1), ("c", "c", 0.35), ("d", "e", 0.45), ("f", "f", 0.25)]


def test_features_of_repeated_edges_and_loops(spark):
    from topograph.operators import graph

    edges = spark.createDataFrame(REPEATED, "a string, b string, w double")
    count, roots = {}, {}
    for p, q, r in itertools.product(REPEATED, repeat=3):
        if p[1] == q[0] and r[0] == p[0] and r[1] == q[1]:
            for node in (p[0], p[1], q[1]):
                count[node] = count.get(node, 0) + 1
                roots[node] = roots.get(node, 0.0) + (p[2] * q[2] * r[2]) ** (1 / 3)
    degree = {n: sum((a == n) + (b == n) for a, b, _ in REPEATED) for n in "abcdef"}
    got = {x["node"]: x for x in graph.node_features(edges, repeated=True).collect()}
    assert len(got) == 6 and graph.node_features(edges, repeated=True).count() == 6
    for n in "abcdef":
        k = degree[n]
        assert (got[n]["degree"], got[n]["triangles"]) == (k, count.get(n, 0))
        assert math.isclose(got[n]["clustering"], 2 * roots.get(n, 0.0) / 0.9 / (k * (k - 1)) if k >= 2 else 0.0, abs_tol=1e-12)
    assert graph.node_features(edges).count() == 6  # two loops at a node make no second row
    plain = edges.filter("(a, b) in (('a', 'b'), ('b', 'c'), ('a', 'c'), ('a', 'd')) and w <> 0.7")
    same = lambda df: {tuple(round(v, 12) if isinstance(v, float) else v for v in x) for x in df.collect()}
    assert same(graph.node_features(plain)) == same(graph.node_features(plain, repeated=True))


def test_simplices_of_repeated_edges_and_loops(spark):
    edges = spark.createDataFrame([(1, *row) for row in REPEATED], "g long, a string, b string, w double")
    members = spark.createDataFrame([(1, n) for n in "abcdefg"] + [(2, "a")], "g long, node string")
    arcs = [(a, b) for a, b, _ in REPEATED]
    three = [(p, q, r) for p, q, r in itertools.product(arcs, repeat=3) if p[1] == q[0] and r == (p[0], q[1])]
    four = sum(u[0] == q[1] and v == (p[0], u[1]) and s == (p[1], u[1]) for p, q, r in three for u, v, s in itertools.product(arcs, repeat=3))
    got = {x["g"]: (x["n_vertices"], x["n_edges"], x["n_triangles"], x["n_tetrahedra"]) for x in homology.simplex_counts(edges, ["g"], members).collect()}
    assert got == {1: (7, len(arcs), len(three), four), 2: (1, 0, 0, 0)} and four


def test_loops_of_a_skeleton_end_components():
    from topograph.functions.rips import skeleton_bars

    births, rows = {"a": 0.1, "b": 0.1, "c": 0.2, "d": 0.3}, [(0.1, "a", "b"), (0.2, "b", "c"), (0.5, "a", "c"), (0.3, "d", "d"), (0.4, "c", "c"), (0.6, "b", "b")]
    inf = float("inf")
    assert sorted(skeleton_bars(births, rows, loops_end=True)) == [(0, 0.1, 0.4), (1, 0.5, inf), (1, 0.6, inf)]
    assert sorted(skeleton_bars(births, rows)) == [(0, 0.1, inf), (0, 0.3, inf), (1, 0.3, inf), (1, 0.4, inf), (1, 0.5, inf), (1, 0.6, inf)]


def test_paths_take_the_shortest_of_repeated_edges(spark):
    import numpy as np

    rows = [("a", "b", 0.5), ("a", "b", 0.9), ("a", "b", 0.2), ("b", "c", 0.4), ("c", "b", 0.7), ("c", "c", 0.9), ("c", "d", -0.5)]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    members = spark.createDataFrame([(1, n) for n in "abcd"], "g long, node string")
    got = {(x["i"], x["j"]): round(x["d"], 9) for x in filtration.distances(edges.filter("w > 0"), members.filter("node <> 'd'"), ["g"], "weighted_shortest_path").collect()}
    assert got == {("a", "b"): 0.1, ("b", "c"): 0.3, ("a", "c"): 0.4}
    listed = [(n, n, None, False, k) for k, n in enumerate("abcd")] + [(*row, True, 0) for row in rows]
    i, j = (np.array(["abcd".index(row[k]) for row in rows]) for k in (0, 1))
    for name, ab in (("weighted_shortest_path", 0.1), ("correlation_distance", 0.1), ("hop_distance", 1.0)):
        for order in (1, -1):
            d = filtration.listed_matrix([*listed[:4], *listed[4:][::order]], name)[1]
            assert round(d[0][1], 9) == ab and np.array_equal(d, filtration.distance_matrix(4, i[::order], j[::order], np.array([row[2] for row in rows])[::order], name))
    assert d[2][3] == 1.0 and filtration.listed_matrix(listed, "correlation_distance")[1][2][3] == 1.5


def test_edges_inside_groups_are_looked_up_once(spark, monkeypatch):
    from topograph.operators import features

    calls, real = [], features.induced_edges
    for module in (features, homology):
        monkeypatch.setattr(module, "induced_edges", lambda *a: calls.append(1) or real(*a))
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.4), ("c", "d", 0.9), ("e", "f", 0.3)], "a string, b string, w double")
    members = spark.createDataFrame([(1, n) for n in "abcd"] + [(2, n) for n in "abef"], "g long, node string")
    got = {x["g"]: x for x in features.subgraph_features(edges, members, ["g"], cap=4).collect()}
    assert len(calls) == 1
    assert [(got[g]["num_edges"], got[g]["num_connected_components"], got[g]["full_num_nodes"]) for g in (1, 2)] == [(3, 1, 4), (2, 2, 4)]
    assert math.isclose(got[1]["distance_matrix_mean"], 2 * (0.5 + 0.6 + 0.1 + 3) / 16)


def test_components_walked_or_contracted(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for g, n in ((1, 5), (2, 12), (3, 30)) for _ in range(n // 2)]
    edges = spark.createDataFrame(sorted({(min(a, b), max(a, b), 0.5) for _, a, b in rows}), "a string, b string, w double")
    members = spark.createDataFrame([(g, f"n{i:02d}") for g, n in ((1, 5), (2, 12), (3, 30)) for i in range(n)], "g long, node string")
    walked = sorted(map(tuple, components.subgraph_components(edges, members, ["g"]).collect()))
    monkeypatch.setattr(components, "WALKED_MEMBERS", 10)
    assert walked == sorted(map(tuple, components.subgraph_components(edges, members, ["g"]).collect())) and len(walked) == 3


def test_expansion_in_memory_and_by_joins(spark, monkeypatch):
    from topograph.operators import neighborhood

    rng = random.Random(9)
    rows = [(f"n{i:02d}", f"n{j:02d}", rng.randint(1, 6) / 6) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.2]
    edges = spark.createDataFrame(rows + [("x", "y", 0.5)], "a string, b string, w double")
    seeds = spark.createDataFrame([(f"n{i:02d}",) for i in range(60)] + [("y",)], "seed string")
    left, real = [], neighborhood._walks_by_joins
    monkeypatch.setattr(neighborhood, "_walks_by_joins", lambda lists, seeds, cap: left.append(seeds.count()) or real(lists, seeds, cap))
    got = {}
    monkeypatch.setattr(neighborhood, "SHARED_LEAST", 2)
    for links, first in ((0, 12), (10**6, 12), (10**6, 2)):
        monkeypatch.setattr(neighborhood, "SHARED_LINKS", links)
        monkeypatch.setattr(neighborhood, "SHARED_FIRST", first)
        got[links, first] = sorted(map(tuple, neighborhood.seed_expansion(edges, seeds, 9).collect()))
    assert got[0, 12] == got[10**6, 12] == got[10**6, 2] and len(got[0, 12]) == 60 * 9 + 2
    assert left[0] == 61 and len(left) == 2 and 0 < left[1] < 61  # of all, and of those that need more than two links of a node


def test_samples_of_whole_graphs_join_no_edges(spark, monkeypatch):
    rng = random.Random(10)
    edges = spark.createDataFrame(sorted({(1, f"n{rng.randrange(20):02d}", f"n{rng.randrange(20, 40)}", 0.5) for _ in range(90)}), "g long, a string, b string, w double")
    nodes = spark.createDataFrame([(1, f"n{i:02d}") for i in range(40)] + [(2, "n01")], "g long, node string")
    want = sorted(map(tuple, homology.sample_for_ph(edges.drop("g"), nodes, ["g"], 12, hubs=4).collect()))
    monkeypatch.setattr(homology, "induced_edges", None)
    assert sorted(map(tuple, homology.sample_for_ph(edges.drop("g"), nodes, ["g"], 12, hubs=4, inside=edges).collect())) == want and len(want) == 13


def test_point_distances_by_blocks():
    """600 vectors: the differences of all pairs at once are 184 MB."""
    import tracemalloc

    import numpy as np

    x = np.random.default_rng(4).normal(size=(600, 64))
    tracemalloc.start()
    d = homology.point_distances(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 << 20
    assert (d == np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).astype(np.float32)).all()


def test_triangles_deal_out_no_wedges(spark):
    """Wedges were dealt out by both open ends, a row each with all weights; repeated edges still count each time."""
    from topograph.operators import graph

    r = random.Random(6)
    rows = [(*sorted(r.sample("ABCDEFGHIJ", 2)), float(k)) for k in range(40)]
    edges = spark.createDataFrame(rows, "a string, b string, w double").repartition(3)
    found = graph.triangles(edges)
    assert "wp" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(tuple(sorted(x[2] for x in three)) for three in itertools.combinations(rows, 3) if len({n for x in three for n in x[:2]}) == 3 and len({x[:2] for x in three}) == 3)
    assert want and sorted(tuple(sorted((x["w_xy"], x["w_xz"], x["w_yz"]))) for x in found.collect()) == want


def _differences(spark, folder, name):
    """Rows that a query or its SQL has more often than the other."""
    import collections

    import duckdb

    import __spark_entry__ as driver

    db = duckdb.connect()
    for table in ("lineitem", "orders"):
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    rows = driver.queries()[name](spark, folder)
    got = collections.Counter(map(tuple, rows.collect()))
    want = collections.Counter(db.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in rows.columns)} from ({driver.oracle_sql()[name]})").fetchall())
    return (got - want) + (want - got)


#: Orders whose parts share names from 1,000,000 on: repeated and turned pairs, loops, and names that small parts have too.
SHARED_NAMES = [(100_000, 1_000_003, 1_000_004, 1_000_011), (1_000_000, 1_000_001, 1_000_002, 1_000_012, 1_000_025), (100_000, 100_001, 1_000_010), (100_002, 1_000_021), (100_001, 100_002, 1_000_000, 1_000_020)]


@pytest.mark.parametrize("name", ["corr_distance_stats", "ego_radius_1_cap", "ego_radius_2_cap", "top_weighted_neighbors", "matrix_sink", "simplex_enumeration", "simplex_cofaces"])
def test_queries_of_shared_names_are_their_sql(spark, tmp_path, name):
    assert not _differences(spark, _star(spark, tmp_path, SHARED_NAMES), name)


def test_simplices_listed_or_joined(spark, monkeypatch):
    r = random.Random(3)
    plain = [(2, a, b, round(r.random(), 3)) for a, b in itertools.combinations("abcdefg", 2) if r.random() < 0.8]
    for repeated in (True, False):
        edges = spark.createDataFrame([(1, *row) for row in REPEATED if repeated] + plain, "g long, a string, b string, w double")
        tree = lambda: sorted((x["g"], x["dim"], tuple(x["vertices"]), tuple(x["prefix"]), x["value"]) for x in homology.simplex_tree(edges, ["g"], 3, repeated=repeated).collect())  # noqa: E731, B023
        counts = lambda: sorted((x["g"], tuple(x["vertices"]), x["n_cofaces"], x["first_value"] or 0.0) for x in homology.coface_counts(edges, ["g"], 3, repeated).collect())  # noqa: E731, B023
        monkeypatch.setattr(homology, "LISTED_EDGES", 512)
        listed = tree(), counts()
        monkeypatch.setattr(homology, "LISTED_EDGES", 0)
        assert (tree(), counts()) == listed
    assert any(dim == 3 for _, dim, *_ in listed[0])


def test_simplices_are_not_dealt_out(spark, monkeypatch):
    tables = []
    real = homology.cut_lineage
    monkeypatch.setattr(homology, "cut_lineage", lambda df, **kw: tables.append(real(df, **kw)) or tables[-1])
    edges = spark.createDataFrame([(1, a, b, 0.5) for a, b in itertools.combinations("abcdef", 2)], "g long, a string, b string, w double")
    assert homology.coface_counts(edges, ["g"], 3).count() == 6 + 15 + 20 + 15
    assert sorted(t.count() for t in tables) == [0, 15]  # edges, and no large group: no table of simplices


def test_skeletons_of_many_groups_need_no_frames(spark, monkeypatch):
    edges = spark.createDataFrame([(1, *row) for row in REPEATED] + [(2, "x", "y", 0.5)], "g long, a string, b string, w double")
    want = sorted(map(tuple, homology.skeleton_persistence(edges, ["g"], loops_end=True).collect()))
    monkeypatch.setattr(homology, "map_groups", None)  # a frame a group
    assert sorted(map(tuple, homology.skeleton_persistence(edges, ["g"], loops_end=True).collect())) == want
    assert [x[1:] for x in want if x[0] == 2] == [(0, 0.5, float("inf"))]


def test_walks_by_joins_keep_no_tables_of_rounds(spark, monkeypatch):
    from topograph.functions import lineage

    rng = random.Random(12)
    rows = [(f"n{i:02d}", f"n{j:02d}", rng.randint(1, 6) / 6) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.3]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    seeds = spark.createDataFrame([(f"n{i:02d}",) for i in range(40)], "seed string")
    want = sorted(map(tuple, neighborhood.seed_expansion(edges, seeds, 12).collect()))
    monkeypatch.setattr(neighborhood, "SHARED_LINKS", 0)
    monkeypatch.setattr(neighborhood, "PAGE_LINKS", 2)
    monkeypatch.setattr(neighborhood, "WAVE_SEEDS", 25)
    before = len(lineage._written)
    found = neighborhood.seed_expansion(edges, seeds, 12)
    assert len(lineage._written) - before == 5  # all links, their pages, whom to ask ahead, and a table a wave
    assert sorted(map(tuple, found.collect())) == want and len(want) == 480


def test_tables_leave_no_shuffle_files(spark):
    from topograph.functions import lineage

    seen, real = [], spark.conf.get(lineage.SHUFFLE_CLEANUP)

    class Spy:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            if name == "write":
                seen.append(spark.conf.get(lineage.SHUFFLE_CLEANUP))
            return getattr(self.of, name)

    assert lineage.cut_lineage(Spy(spark.range(5))).count() == 5
    assert seen == ["true"] and spark.conf.get(lineage.SHUFFLE_CLEANUP) == real


def test_cosines_send_vectors_by_their_groups_blocks(spark, monkeypatch):
    from topograph.operators import ranking

    rows = spark.createDataFrame([(k % 30, k, [1.0, float(k)]) for k in range(300)], "label int, id long, v array<double>")
    tables, real = [], ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: tables.append(real(df)) or tables[-1])
    monkeypatch.setattr(ranking, "BLOCK", 20)
    assert ranking.cosines(rows, "label").count() == 30 * 45
    assert tables[-1].count() == 30  # a block a group of 10, however many groups there are
