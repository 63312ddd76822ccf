"""Graph, set, neighbourhood and statistics operators on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topograph.functions import logistic
from topograph.functions.controls import Adjacency, grow, match
from topograph.operators import features, filtration, graph, homology, neighborhood, ranking, sampling, sets
from topograph.operators.components import subgraph_components
from topograph.plans import experiments
from topograph.sources import network, sinks


@pytest.fixture(scope="module")
def edges(spark):
    return graph.canonical_edges(network.toy_network(spark)).select("a", "b", "w").persist()


def groups(spark, *members):
    return spark.createDataFrame([(i, p, m) for i, g in enumerate(members) for p, m in enumerate(g)], "complex_id long, pos int, member string")


def test_coverage(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    got = features.coverage_summary(groups(spark, "AB", "AD"), nodes).first()
    assert (got["num_complexes"], got["fraction_complexes_fully_covered"], got["fraction_complex_members_observed"]) == (2.0, 0.5, 0.75)
    empty = features.coverage_summary(groups(spark, "A").limit(0), nodes).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_last_of_repeated_edges_counts(spark):
    rows = spark.createDataFrame([("A", "B", 0.1, 0), ("B", "A", 0.9, 1), ("C", "C", None, 2)], "ProteinA string, ProteinB string, SemSim double, ord long")
    got = {(x["a"], x["b"]): x["w"] for x in graph.canonical_edges(rows).collect()}
    assert got == {("A", "B"): 0.9, ("C", "C"): None}
    degree = {x["node"]: (x["degree"], x["strength"]) for x in graph.degree_strength(graph.canonical_edges(rows)).collect()}
    assert degree == {"A": (1, 0.9), "B": (1, 0.9), "C": (2, 2.0)}  # a loop counts twice, a missing weight is 1


def test_node_features(edges):
    got = {x["node"]: x for x in graph.node_features(edges).collect()}
    assert got["A"]["degree"] == 3 and got["A"]["triangles"] == 1
    assert math.isclose(got["A"]["clustering"], 2 * (0.9 * 0.8 * 0.7) ** (1 / 3) / 0.95 / 6)
    assert got["F"]["clustering"] == 0


def test_neighbourhoods(spark, edges):
    seeds = spark.createDataFrame([("A",)], "seed string")
    nodes = lambda method, cap: {x["node"] for x in neighborhood.neighborhood(edges, seeds, method, cap).collect()}
    assert nodes("top_weighted_neighbors", 3) == {"A", "B", "C"}
    assert nodes("seed_expansion", 4) == {"A", "B", "C", "E"}
    for method in neighborhood.NEIGHBORHOODS:
        got = nodes(method, 4)
        assert "A" in got and len(got) <= 4
    with pytest.raises(ValueError):
        nodes("no such method", 3)
    with pytest.raises(ValueError):
        nodes("ego_radius_1", 0)
    with pytest.raises(ValueError):
        neighborhood.neighborhood(edges, spark.createDataFrame([("Z",)], "seed string"), "ego_radius_1", 3)


def test_filtrations(spark, edges):
    members = graph.node_set(edges).selectExpr("0 as g", "node")
    for name in filtration.FILTRATIONS:
        assert filtration.distances(edges, members, ["g"], name).count() == 15
    i, j, w = np.array([0, 1]), np.array([1, 2]), np.array([0.5, np.nan])
    hop = filtration.distance_matrix(4, i, j, w, "hop_distance")
    assert hop[0, 2] == 2 and hop[0, 3] == 3 and not hop.diagonal().any()
    assert filtration.distance_matrix(3, i, j, w, "weighted_shortest_path")[0, 2] == 1.5
    assert filtration.distance_matrix(3, i, j, w, "correlation_distance")[1, 2] == 0
    assert filtration.distance_matrix(0, i[:0], j[:0], w[:0], "hop_distance").shape == (0, 0)
    with pytest.raises(ValueError):
        filtration.check_filtration("other")


def test_components_and_summary(spark, edges):
    members = spark.createDataFrame([(0, n) for n in "ABCF"] + [(1, "E"), (1, "D")], "g long, node string")
    assert {x["g"]: x["n_components"] for x in subgraph_components(edges, members, ["g"]).collect()} == {0: 2, 1: 2}
    row = features.graph_ph_summary(edges, members, ["g"]).filter("g = 0").first()
    assert row["num_nodes"] == 4 and row["num_edges"] == 3 and row["ph_dim0_count"] == 4 and row["ph_dim0_finite_count"] == 3
    assert math.isclose(row["distance_matrix_mean"], 1 - (4 + 2 * (0.9 + 0.8 + 0.7)) / 16)


def test_landscape_constants(spark):
    bars = spark.createDataFrame([(1, 1, 0.2, 0.7)], "g long, dim int, birth double, death double")
    got = homology.landscape_features(bars, ["g"]).first()
    assert math.isclose(got["landscape_max"], 50 / 101 * 0.5 * math.sqrt(2)) and math.isclose(got["landscape_l1"], 2550 / 101 * 0.5 * math.sqrt(2))
    summary = homology.diagram_summary(bars, ["g"], spark.createDataFrame([(1,), (2,)], "g long")).filter("g = 2").first()
    assert all(v == 0.0 for k, v in summary.asDict().items() if k != "g")


def test_ranking(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.2), (2, 1, 0.8), (3, 1, 0.9)], "k long, y int, s double")
    assert ranking.auroc(df, [], "s", "y", "k").first()[0] == 1.0 and ranking.average_precision(df, [], "s", "y", "k").first()[0] == 1.0
    y, s = np.array([0, 1, 0, 1]), np.array([0.5, 0.5, 0.5, 0.1])
    ties = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "k long, y int, s double")
    assert ranking.auroc(ties, [], "s", "y", "k").first()[0] == logistic.auroc(y, s)
    assert ranking.average_precision(ties, [], "s", "y", "k").first()[0] == logistic.average_precision(y, s)
    assert ranking.auroc(df.filter("y = 1"), [], "s", "y", "k").first()[0] == 0.5
    third = spark.createDataFrame([("a", i, int(i == 2), 1.0 - i / 10) for i in range(8)], "g string, k long, y int, s double")
    assert abs(ranking.average_precision(third, ["g"], "s", "y", "k").first()["average_precision"] - 1 / 3) < 1e-12
    assert abs(ranking.average_precision(third, [], "s", "y", "k").first()[0] - 1 / 3) < 1e-12


def test_logistic():
    x = np.array([[0.0, 1], [1, 1], [2, 1], [3, 1]])
    model = logistic.fit(x, np.array([0, 0, 1, 1]))
    scores = logistic.predict(model, x)
    assert (np.diff(scores) > 0).all() and model[1, 1] == 1 and abs(model[-1, 2]) < 1e-9
    assert logistic.test_count(10, 0.25) == 2 and logistic.test_count(1, 0.1) == 1
    assert logistic.one_repeat(x, np.array([0, 0, 0, 0]), np.array([True, False, False, False]), False) is None


def test_distributed_metrics_equal_those_in_a_task(spark, monkeypatch):
    """Of plain and grouped splits, of splits without two classes, and of tables that no split suits."""
    from topograph.plans import modelling
    from topograph.schema import Splits

    r = np.random.default_rng(0)
    x = r.normal(size=(40, 2))
    y = (x[:, 0] + 0.3 * r.normal(size=40) > 0.9).astype(int)
    rows = [(i, f"g{i % 6}", float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k long, g string, p double, q double, y int")
    tables = [(df, None, 1), (df, "g", 1), (df.filter("y = 0"), None, 1), (df.filter("k < 8"), "g", 1)]
    got = {}
    for most in (200_000, 0):
        monkeypatch.setattr(modelling, "ROWS_PER_TASK", most)
        got[most] = [sorted(tuple(m) for m in modelling.repeat_metrics(t, {"one": ["p", "q"]}, "k", "y", Splits(n), 5, grouped_by=g, steps=6).collect()) for t, g, n in tables]
    for small, large in zip(got[200_000], got[0]):
        assert [m[:2] for m in small] == [m[:2] for m in large] and np.allclose([m[2:] for m in small], [m[2:] for m in large])
    assert got[0][0] and not got[0][2]
    halves = df.withColumn("half", F.when(F.col("k") % 2 == 0, "even").otherwise("odd")).withColumn("other", (F.col("q") > 0).cast("int")).withColumn("flat", F.lit(0.1))
    models = {"all": ["p", "q", "flat"], "even": ["p"], "odd": ["p", "q"], "mixed": ["p"]}
    how = {"parts": ("half", {"all": "even", "even": "even", "odd": "odd", "mixed": "odd"}), "labels": {"mixed": "other"}}
    both = []
    for most in (200_000, 0):
        monkeypatch.setattr(modelling, "ROWS_PER_TASK", most)
        both.append(sorted(tuple(m) for m in modelling.repeat_metrics(halves.repartition(3), models, "k", "y", Splits(3), {m: i for i, m in enumerate(models)}, steps=30, **how).collect()))
    assert len(both[0]) > 6 and [m[:2] for m in both[0]] == [m[:2] for m in both[1]] and np.allclose([m[2:] for m in both[0]], [m[2:] for m in both[1]])
    monkeypatch.setattr(modelling, "ROWS_PER_TASK", 200_000)
    means = modelling.mean_metrics(modelling.repeat_metrics(df, {"one": ["p"]}, "k", "y", Splits(2), 5), ["one", "none"]).collect()
    assert {m["model"]: (len(m["auroc_values"]), m["n_repeats"]) for m in means} == {"one": (2, 2), "none": (0, 0)}


def test_triangles_intersect_lists_by_hashes(spark):
    """Comparing every name of a list with every one of another grows with the cube of a hub's links; pairs that repeat still count each time."""
    rows = [("a", "b", 0.1), ("b", "c", 0.2), ("a", "c", 0.3), ("a", "c", 0.4), ("b", "d", 0.5), ("c", "d", None), ("a", "e", 0.6), ("a", "a", 0.7)]
    found = graph.triangles(spark.createDataFrame(rows, "a string, b string, w double"))
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((tuple(sorted(r[:3])), tuple(sorted(r[3:]))) for r in found.collect())
    assert got == [(("a", "b", "c"), (0.1, 0.2, 0.3)), (("a", "b", "c"), (0.1, 0.2, 0.4)), (("b", "c", "d"), (0.2, 0.5, 1.0))]


def test_a_descent_step_is_one_job(spark, monkeypatch):
    """Hundreds of steps follow one another, so what each costs beside its sums counts."""
    from topograph.plans import modelling
    from topograph.schema import Splits

    monkeypatch.setattr(modelling, "ROWS_PER_TASK", 0)
    df = spark.range(60).select("id", (F.col("id") % 7).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y")).repartition(3)
    sc, jobs = spark.sparkContext, []
    for steps in (2, 12):
        sc.setJobGroup(f"steps {steps}", "")
        modelling.repeat_metrics(df, {"one": ["p"]}, "id", "y", Splits(2), 5, steps=steps)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"steps {steps}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 10


def test_sampling(spark, edges):
    assert sampling.subsample_edges(edges, 0.5, 1).count() == 3 and sampling.subsample_nodes(edges, 0.5, 1).count() == 3
    assert [x["node"] for x in sampling.hubs(edges, 0.1).collect()] == ["A"]
    assert all(0 <= x["w"] <= 1 for x in sampling.jitter_weights(edges, 0.5, 3).collect())
    rows = spark.createDataFrame([(i, i % 2, "x" if i < 6 else "y") for i in range(10)], "k long, y int, bin string")
    mixed = sampling.shuffle_labels(rows, "k", "y", 1, ["bin"]).groupBy("bin").sum("shuffled").collect()
    assert {x["bin"]: x[1] for x in mixed} == {"x": 3, "y": 2}


def test_matched_controls():
    names = np.array([f"n{i:02d}" for i in range(12)])
    a, b = zip(*[(names[i], names[(i + 1) % 12]) for i in range(12)])
    g = Adjacency(np.array(a), np.array(b), np.full(12, 0.5))
    nodes = grow(g, 4, {0, 1}, 0.1, 1, (5, 0))
    assert len(set(nodes)) == 4 and nodes == grow(g, 4, {0, 1}, 0.1, 1, (5, 0))
    found, score, (density, degree, strength) = match(g, [0, 1, 2], 20, 0.0, 0.15, 0.35, 7, (0, 0))
    assert len(found) == 3 and score >= 0 and math.isclose(density, 2 / 3) and degree == 2 and math.isclose(strength, 2 / 3)


def test_controls_by_joins_are_those_in_memory(spark):
    import random

    from topograph.schema import Controls

    r = random.Random(3)
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(70)}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", round(r.random(), 3)) for a, b in sorted(pairs)] + [("n00", "n00", 0.5)], "a string, b string, w double")
    real = spark.createDataFrame([(g, f"n{v:02d}") for g, vs in enumerate([(0, 1, 2, 3), (4, 9, 11), (5, 6, 7, 8, 12)]) for v in vs], "complex_id long, node string")
    for how in (Controls(2, 3, restart=0.3, density_tolerance=0.05), Controls(1, 2, density_tolerance=5.0, degree_tolerance=5.0)):
        both = [{(x["complex_id"], x["control"], x["node"]): x["match_score"] for x in f(edges, real, how, 7).collect()} for f in (experiments._controls_in_memory, experiments._controls_by_joins)]
        assert both[0].keys() == both[1].keys() and len(both[0]) == how.per_group * 12
        assert all(math.isclose(v, both[1][k], abs_tol=1e-9) for k, v in both[0].items())


def test_ranks_and_first_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "a" if i % 7 else "b", None if i % 5 == 0 else "x") for i in range(100)], "k long, g string, h string").repartition(6)
    assert {x["k"]: x["rank"] for x in ranking.ranked(df, [F.col("k").desc()]).collect()} == {k: 99 - k for k in range(100)}
    got = {x["k"]: x["rank"] for x in ranking.ranked_within(df, ["g", "h"], [F.col("k")]).collect()}
    keys = lambda k: (bool(k % 7), bool(k % 5))
    assert got == {k: sum(keys(j) == keys(k) for j in range(k)) for k in range(100)}
    assert sorted(x["k"] for x in ranking.first_rows(df, [F.col("k")], 13).collect()) == list(range(13))
    assert ranking.ranked(df.limit(0), [F.col("k")]).count() == 0
    assert sorted(x["row_idx"] for x in ranking.with_row_index(df, "k").collect()) == list(range(100))


def test_induced_edges_of_small_and_large_groups(spark, edges, monkeypatch):
    members = spark.createDataFrame([(0, n) for n in "ABCDEF"] + [(1, n) for n in "ABC"] + [(1, "A"), (2, "Z")], "g long, node string")
    loops = edges.union(spark.createDataFrame([("A", "A", None)], edges.schema))
    want = None
    for most in (64, 2):
        monkeypatch.setattr(graph, "PAIRED_MEMBERS", most)
        got = sorted((x["g"], x["a"], x["b"]) for x in graph.induced_edges(loops, members, ["g"]).collect())
        assert want in (None, got)
        want = got
    assert len(want) == 7 + 4


def test_component_bars_are_the_kernels(spark):
    import random

    from topograph.functions.rips import rips_bars

    r = random.Random(2)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", r.choice([0.0, 0.25, 0.5, 0.9, 1.0, None])) for a in range(9) for b in range(a + 1, 9) if r.random() < 0.4], "a string, b string, w double")
    members = spark.createDataFrame([(g, f"n{v}") for g in range(12) for v in r.sample(range(9), r.randrange(1, 9))], "g long, node string")
    got = sorted(tuple(x) for x in homology.subgraph_bars(edges, members, ["g"], maxdim=0).collect())
    rows = filtration.with_members(edges, members, ["g"]).toPandas()
    want = sorted((g, *bar) for g, part in rows.groupby("g") for bar in rips_bars(filtration.subgraph_matrix(part.sort_values("is_edge", kind="stable"), "correlation_distance")[1], 0))
    assert np.allclose(got, want) and len(got) == len(want)


def test_tables_from_bars_and_edges(spark, edges):
    members = graph.node_set(edges).selectExpr("0 as g", "node")
    bars = homology.subgraph_bars(edges, members, ["g"])
    inside = edges.selectExpr("0 as g", "*")
    deaths = {round(x["death"], 4) for x in bars.filter("dim = 0").collect()}
    found = homology.edges_at(inside, bars.filter("dim = 0"), ["g"]).collect()
    assert found and all(round(1 - x["w"], 4) in deaths for x in found)
    assert {x["dim"]: len(x["diagram"]) for x in homology.diagrams(bars, ["g"]).collect()}[0] == 6
    density = homology.persistence_density(spark.createDataFrame([(0, 1, 0.5, 0.5 + 0.25)], "g long, dim int, birth double, death double"), ["g"], 1, 0.1, 41)
    assert abs(sum(x["value"] for x in density.collect()) * (1 / 40) ** 2 - 1) < 0.02
    cells = {(x["a"], x["b"]): x["w"] for x in filtration.infinite_adjacency(edges, members, ["g"]).collect()}
    assert len(cells) == 15 and cells["A", "B"] == 0.9 and cells["A", "F"] == math.inf
    lone = spark.createDataFrame([("A", "B", 0.5), ("C", "D", 0.25)], "a string, b string, w double")
    paths = {(x["i"], x["j"]): x["d"] for x in filtration.path_distances(lone, graph.node_set(lone).selectExpr("0 as g", "node"), ["g"]).collect()}
    assert paths["A", "B"] == 0.5 and paths["A", "C"] == math.inf
    binary = filtration.distance_matrix(3, np.array([0]), np.array([1]), np.array([0.3]), "binary")
    assert binary[0, 1] == 0 and binary[0, 2] == 1
    isolated = sets.isolated_pairs(lone.union(spark.createDataFrame([("D", "E", 1.0)], lone.schema)))
    assert [(x["a"], x["b"], x["w"]) for x in isolated.collect()] == [("A", "B", 0.5)]
    assert [x["member"] for x in sets.first_seen(groups(spark, "BA", "AC")).collect()] == ["B", "A", "C"]
    assert [x["node"] for x in graph.sorted_by_degree(edges).collect()][0] == "A"
    pareto = graph.pareto_graph(spark, 60, 1).collect()
    assert all(x["a"] != x["b"] for x in pareto)
    assert len(homology.landscape_vectors(bars.withColumn("dim", bars["dim"] + 1), ["g"]).first()["landscape"]) == 500


def test_matrices_and_layout(spark, tmp_path, edges):
    from topograph.sources.layout import Layout

    rows = {x["row"]: dict(zip(x["columns"], x["values"])) for x in sinks.compressed_rows(edges).collect()}
    assert rows[0] == {1: 0.9, 2: 0.8, 3: 0.2} and rows[5] == {3: 0.95}
    sinks.write_matrix(edges, f"file://{tmp_path}/m", dense=True)
    lines = [[float(v) for v in x["value"].split("\t")] for x in spark.read.text(f"file://{tmp_path}/m").collect()]
    assert np.allclose(np.array(lines), np.array(lines).T) and len(lines) == 6 and lines[0][1] == 0.9
    layout = Layout(f"file://{tmp_path}/out/").prepare(spark)
    assert (tmp_path / "out/results/reports").is_dir() and layout.data == f"file://{tmp_path}/out/data"
    toy, toy_groups = network.toy_benchmark(spark)
    assert toy.count() == 20 and sets.group_sizes(toy_groups).count() == 6 and graph.node_set(graph.canonical_edges(toy)).count() == 17


def test_workflows_end_to_end(spark, tmp_path):
    import json
    import random

    from topograph.plans import workflows
    from topograph.schema import Controls, DecisionConfig, ExplorationConfig, Panel, Sizes, Splits, SweepConfig

    r = random.Random(9)
    pairs = {tuple(sorted(r.sample(range(24), 2))) for _ in range(60)}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", round(r.random(), 3)) for a, b in sorted(pairs)], "a string, b string, w double").persist()
    own = groups(spark, *[[f"n{v:02d}" for v in r.sample(range(12), k)] for k in (3, 4, 5, 3, 4, 3)]).persist()
    out = f"file://{tmp_path}/out"
    reference = workflows.reference_run(spark, edges, own, out, node_cap=12)
    assert reference["coverage"]["num_complexes"] == 6 and set(reference["bars"]) <= set("0123") and "simplices" in reference["rips_complex"]["summary"]
    sizes, controls, splits, panel = Sizes(3, 10, 6), Controls(1, 3), Splits(2, 0.4), Panel(6, 6)
    decision = workflows.decision_run(spark, edges, own, DecisionConfig(groups=sizes, controls=controls, splits=splits, node_cap=8))
    assert decision["verdict"] in ("go", "conditional_go", "no_go") and set(decision["complex_models"]) == {"baseline", "ph", "combined"}
    exploration = workflows.exploration_run(spark, edges, own, ExplorationConfig(filtrations=("hop_distance",), splits=splits, panel=panel, neighborhood_cap=6, groups=sizes, controls=controls, node_cap=8))
    assert set(exploration["local"]) == {"baseline", "hop_distance:ph_only", "hop_distance:baseline_plus_ph", "hop_distance:label_shuffle_null"}
    sweep = workflows.sweep_run(spark, edges, own, SweepConfig(protocols=("top_weighted_neighbors", "ego_radius_1"), neighborhood_caps=(4, 6), splits=splits, panel=panel), out)
    assert len(sweep["metrics"]) == 1 + 2 * 2 * 3 and sweep["best"]["model"].endswith("baseline_plus_ph")
    assert json.loads((tmp_path / "out/results/reports/report.json").read_text())["best"] == sweep["best"]


def test_verdicts(spark):
    from pyspark.sql import functions as F

    v = lambda *x: spark.range(1).select(experiments.verdict(*[F.lit(y) for y in x])).first()[0]
    assert v(0.9546, 0.97745, 0.96, 0.945, 0.99, 0.5633) == "conditional_go"
    assert v(0.9546, 0.97745, 0.9394, 0.8934, 0.9254, 0.4594) == "no_go"
    assert v(0.9, 0.95, 0.8, 0.8, 0.9, 0.5) == "go"


def test_files(spark, tmp_path, edges):
    (tmp_path / "ppi.tsv").write_text("A\tB\t0.5\nB\tC\t0.25\n")
    (tmp_path / "groups.txt").write_text("A\tB\t\n\nC\tC\n")
    (tmp_path / "spaced.txt").write_text(" A B  C \r\n")
    assert network.read_edges(spark, f"{tmp_path}/ppi.tsv").count() == 2
    assert network.read_edges(spark, f"{tmp_path}/ppi.tsv", header=True, weighted=False).filter("SemSim is null").count() == 1
    rows = [(x["complex_id"], x["pos"], x["member"]) for x in network.read_complexes(spark, f"{tmp_path}/groups.txt").orderBy("complex_id", "pos").collect()]
    assert rows == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (1, 1, "C")]
    assert network.read_complexes(spark, f"{tmp_path}/spaced.txt", r"\s+").count() == 3
    sinks.write_json(spark, {"b": 1, "a": [2]}, f"file://{tmp_path}/r/x.json")
    assert (tmp_path / "r/x.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}'
    sinks.write_table(edges, f"file://{tmp_path}/t", single=True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").count() == 6
    assert sets.member_pairs(groups(spark, "ABC"), ordered=True).count() == 6


def test_synthetic(spark):
    from topograph.plans.workflows import environment_report, synthetic_sanity
    from topograph.schema import SyntheticConfig

    report, top = synthetic_sanity(spark, SyntheticConfig(seed=11))
    assert report["num_nodes"] == 100 and report["config"]["group_sizes"] == (10, 7, 5) and top.count() == 10
    assert environment_report(spark)["spark"] == spark.version


def test_registered_experiments_have_the_default_settings(monkeypatch):
    from topograph.plans import catalog
    from topograph.schema import DecisionConfig, ExplorationConfig, SweepConfig

    seen = []
    for name in ("_graph", "_groups", "_proteins", "cut_lineage"):
        monkeypatch.setattr(catalog, name, lambda *a: None)
    for name in ("ph_stability", "complex_vs_random", "null_controls", "local_ph", "filtration_comparison", "protocol_sweep"):
        monkeypatch.setattr(experiments, name, lambda *a: seen.append(a[-1]) or (None, None))
    want = {"global_ph_stability": DecisionConfig, "complex_vs_random": DecisionConfig, "null_controls": DecisionConfig, "local_ph": ExplorationConfig, "filtration_comparison": ExplorationConfig, "protocol_sweep": SweepConfig}
    for name, kind in want.items():
        seen.clear()
        catalog.QUERIES[name](None, "")
        assert seen and all(config == kind() for config in seen), name
