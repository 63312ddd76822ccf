"""Workflows: from an edge list and groups to tables and a report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.functions.lineage import cut_lineage
from topograph.operators import features, graph, homology, sets
from topograph.plans import experiments
from topograph.schema import DecisionConfig, ExplorationConfig, SweepConfig, SyntheticConfig, config_to_dict
from topograph.sources.layout import Layout
from topograph.sources.sinks import rips_summary_line, write_json, write_table


def _report(**parts: object) -> dict[str, object]:
    return {"timestamp_utc": datetime.now(timezone.utc).isoformat(), **parts}


def _one(df: DataFrame) -> dict[str, object]:
    return df.first().asDict()


def _metrics(df: DataFrame) -> dict[str, dict[str, object]]:
    """A row per model: bounded by the configuration."""
    return {r["model"]: {k: v for k, v in r.asDict().items() if k != "model"} for r in df.collect()}


def _plain(df: DataFrame) -> DataFrame:
    """Without columns that a CSV table can't hold."""
    return df.select(*[f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("array", "struct"))])


def _save(spark: SparkSession, out: str | None, report: dict, tables: dict[str, DataFrame]) -> dict:
    """The report, and under out (if given) its JSON and the tables as CSV."""
    if out:
        layout = Layout(out).prepare(spark)
        for name, df in tables.items():
            write_table(_plain(df), f"{layout.processed}/{name}")
        write_json(spark, report, f"{layout.reports}/report.json")
    return report


def synthetic_sanity(spark: SparkSession, config: SyntheticConfig = SyntheticConfig()) -> tuple[dict[str, object], DataFrame]:
    """A random graph with strengthened groups, its size, and the ten highest degrees."""
    n, seed = config.nodes, config.seed
    from topograph.functions.hashing import digest

    names = spark.range(1, n + 1).select(F.concat(F.lit("Protein_"), F.col("id").cast("string")).alias("member"))
    groups = None
    for i, size in enumerate(config.group_sizes):
        part = names.orderBy(digest(seed + 100 + i, F.col("member")), "member").limit(size).select(F.lit(i).cast("long").alias("complex_id"), "member").withColumn("pos", F.monotonically_increasing_id().cast("int"))
        groups = part if groups is None else groups.union(part)
    edges = graph.boost_complexes(graph.random_graph(spark, n, config.edge_probability, seed), groups)
    top = features.degree_baseline(edges, groups).limit(10)
    facts = edges.agg(F.count(F.lit(1)).alias("m")).first()["m"]
    return {"config": config_to_dict(config), "num_nodes": n, "num_edges": facts, "mean_degree": 2 * facts / n, "num_complexes": len(config.group_sizes)}, top


def reference_run(spark: SparkSession, edges: DataFrame, groups: DataFrame, out: str | None = None, node_cap: int = 120, maxdim: int = 3, min_degree: int = 1) -> dict:
    """Coverage, degree tables, and persistence to dimension 3 of the sampled graph (the whole one's complex would be complete)."""
    nodes = graph.node_set(edges).withColumn("graph", F.lit("all"))
    members = cut_lineage(homology.sample_for_ph(edges, nodes, ["graph"], node_cap))
    bars = cut_lineage(homology.subgraph_bars(edges, members, ["graph"], maxdim=maxdim))
    histogram, baseline = graph.degree_histogram(edges), features.degree_baseline(edges, groups)
    inside = cut_lineage(graph.induced_edges(edges, members, ["graph"]))
    counts = _one(homology.simplex_counts(inside, ["graph"], members))
    dimension = max(d for d, c in enumerate(("n_vertices", "n_edges", "n_triangles", "n_tetrahedra")) if counts[c] or not d)
    report = _report(
        coverage=_one(features.coverage_summary(groups, nodes)),
        rips_complex=counts | {"summary": rips_summary_line(dimension, counts["n_simplices"], counts["n_vertices"])},
        persistence=_one(homology.diagram_summary(bars, ["graph"], members)),
        bars={str(r["dim"]): r["n"] for r in bars.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()},
        eligible=sets.eligible(groups, nodes, 3, 40).count(),
        nodes_of_degree=sets.degree_at_least(edges, min_degree).count(),
    )
    tables = {"degree_histogram": histogram, "degree_baseline": baseline, "barcode": homology.barcode_rows(bars, ["graph"]), "landscape": homology.landscape_values(bars, ["graph"]), "persistence_density": homology.persistence_density(bars, ["graph"], 1, 0.05, 50)}
    return _save(spark, out, report, tables)


def decision_run(spark: SparkSession, edges: DataFrame, groups: DataFrame, config: DecisionConfig = DecisionConfig(), out: str | None = None) -> dict:
    sanity = _one(features.data_sanity(edges, groups))
    proteins, signal, protein_metrics = experiments.protein_baseline(edges, groups, config)
    stability = cut_lineage(experiments.ph_stability(edges, config))
    table, metrics = experiments.complex_vs_random(edges, groups, config)
    nulls = experiments.null_controls(proteins, table, config)
    cosines = _one(stability.filter("perturbation <> 'original'").agg(F.avg("cosine_to_original").alias("mean"), F.min("cosine_to_original").alias("min")))
    models, null = _metrics(metrics), _metrics(nulls)
    values = [float(sanity["complex_coverage"] or 0), float(cosines["mean"] or 0), *[float(models[m]["mean_auroc"]) for m in ("baseline", "ph", "combined")], float(null["complex_label_shuffle"]["mean_auroc"])]
    decided = spark.range(1).select(experiments.verdict(*[F.lit(v) for v in values]).alias("v")).first()["v"]
    report = _report(config=config_to_dict(config), data_sanity=sanity, protein_models=_metrics(protein_metrics), stability=cosines, complex_models=models, null_controls=null, verdict=decided)
    return _save(spark, out, report, {"protein_features": proteins, "protein_univariate_signal": signal, "global_ph_stability": stability, "complex_vs_random_features": table})


def exploration_run(spark: SparkSession, edges: DataFrame, groups: DataFrame, config: ExplorationConfig = ExplorationConfig(), out: str | None = None) -> dict:
    proteins = cut_lineage(features.protein_features(edges, groups))
    table, local = experiments.local_ph(edges, proteins, config)
    compared = experiments.filtration_comparison(edges, groups, config)
    report = _report(config=config_to_dict(config), local=_metrics(local), filtrations=_metrics(compared))
    return _save(spark, out, report, {"local_neighborhood_features": table, "local_neighborhood_metrics": local, "filtration_comparison_metrics": compared})


def sweep_run(spark: SparkSession, edges: DataFrame, groups: DataFrame, config: SweepConfig = SweepConfig(), out: str | None = None) -> dict:
    swept = experiments.protocol_sweep(edges, cut_lineage(features.protein_features(edges, groups)), config)
    best = experiments.best_protocol(swept).first()
    report = _report(config=config_to_dict(config), metrics=_metrics(swept), best=best.asDict() if best else None)
    return _save(spark, out, report, {"protocol_sweep_metrics": swept})


def environment_report(spark: SparkSession) -> dict[str, str | None]:
    """Versions of what the package needs; None where a module is missing."""
    from importlib import import_module

    found: dict[str, str | None] = {"spark": spark.version}
    for name in ("numpy", "pandas", "pyarrow"):
        try:
            found[name] = import_module(name).__version__
        except ImportError:
            found[name] = None
    return found
