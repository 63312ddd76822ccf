"""The experiments: each composes operators into one table, with small reports on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.hashing import hashed, hashed_uniform
from topograph.functions.lineage import cut_lineage
from topograph.operators.features import data_sanity, graph_ph_summary, protein_features, size_bin, subgraph_basics, subgraph_features
from topograph.operators.graph import degree_strength, node_set, symmetric
from topograph.operators.homology import sample_for_ph
from topograph.operators.neighborhood import neighborhood
from topograph.operators.ranking import cosine, univariate_signal
from topograph.operators.sampling import hubs, jitter_weights, panel, shuffle_labels, subsample_edges, subsample_nodes
from topograph.operators.sets import eligible, index_dictionary, members_in_graph, remove_nodes
from topograph.plans.modelling import mean_metrics, repeat_metrics
from topograph.schema import GRAPH_PH_COLUMNS, PROTEIN_FEATURES, SUBGRAPH_FEATURES, Controls, DecisionConfig, ExplorationConfig, Sizes, SweepConfig

#: Most edges of a graph whose adjacency is sent to all workers; a larger one is walked by joins, with the same choices.
BROADCAST_EDGES = 2_000_000
TARGETS = ["match_score", "target_density", "target_mean_degree", "target_mean_strength"]


def protein_baseline(edges: DataFrame, groups: DataFrame, config: DecisionConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, univariate signal, and split metrics of the six graph features."""
    rows = cut_lineage(protein_features(edges, groups))
    signal = univariate_signal(rows, PROTEIN_FEATURES, "protein_in_any_complex", "protein")
    per = repeat_metrics(rows, {"protein_baseline": PROTEIN_FEATURES}, "protein", "protein_in_any_complex", config.splits, config.seed)
    return rows, signal, mean_metrics(per, ["protein_baseline"])


def perturbed(edges: DataFrame, config: DecisionConfig) -> DataFrame:
    """(perturbation, a, b, w) of the original graph and its four perturbations."""
    seed, how = config.seed, config.perturbations
    kept = subsample_nodes(edges, how.nodes_kept, seed + 12)
    parts = {
        "original": edges.select("a", "b", "w"),
        "weight_jitter": jitter_weights(edges, how.weight_noise, seed + 10),
        "edge_subsample": subsample_edges(edges, how.edges_kept, seed + 11).select("a", "b", "w"),
        "node_subsample": edges.join(kept.withColumnRenamed("node", "a"), "a", "left_semi").join(kept.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "w"),
        "hub_removal": remove_nodes(edges, hubs(edges, how.hubs_removed)).select("a", "b", "w"),
    }
    out = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("perturbation"), "a", "b", "w")
        out = row if out is None else out.union(row)
    return out


def ph_stability(edges: DataFrame, config: DecisionConfig) -> DataFrame:
    """Persistence summaries of the sampled graph and its perturbations, with their cosine to the original."""
    # Samples are drawn inside each perturbation; its name becomes part of the node so that one plan serves all.
    tag = lambda c: F.concat_ws("\x01", "perturbation", c).alias(c)
    tagged = cut_lineage(perturbed(edges, config).select("perturbation", tag("a"), tag("b"), "w"))
    # A perturbation's sample is of all its nodes: its edges are all inside.
    members = cut_lineage(sample_for_ph(tagged, node_set(tagged, ["perturbation"]), ["perturbation"], config.perturbations.node_cap, config.seed, inside=tagged))
    summary = cut_lineage(graph_ph_summary(tagged.drop("perturbation"), members, ["perturbation"]))
    ph = [c for c in GRAPH_PH_COLUMNS if c.startswith("ph_")]
    long = summary.select("perturbation", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in ph])).alias("x")).select("perturbation", "x.c", "x.v")
    pairs = long.join(long.filter("perturbation = 'original'").select("c", F.col("v").alias("o")), "c")
    return summary.join(cosine(pairs, ["perturbation"], "v", "o").withColumnRenamed("cosine", "cosine_to_original"), "perturbation").withColumn("sampled_nodes", F.col("num_nodes"))


def grow_candidates(edges: DataFrame, specs: DataFrame, keys: list[str], excluded: DataFrame, seed: int, restart: float, filter_frontier: bool = False) -> DataFrame:
    """specs: keys, complex_id, target_size. Connected candidates (keys, complex_id, target_size, node), grown together one node a round.

    Starts and restarts avoid the group's own members (excluded: complex_id, node); frontiers don't unless filter_frontier.
    functions/controls.py grows the same candidates one by one.
    """
    index = cut_lineage(index_dictionary(node_set(edges)))
    n = index.count()
    links = cut_lineage(symmetric(edges.filter("a <> b")).select("node", F.col("nbr").alias("next")).distinct())  # every round reads it
    banned = excluded.select("complex_id", F.col("node").alias("next"))
    taken = excluded.groupBy("complex_id").agg(F.count(F.lit(1)).alias("__taken"))
    largest = specs.agg(F.max("target_size")).first()[0] or 0
    prefix = F.concat_ws("|", *keys)

    def fresh(growing: DataFrame, chosen: DataFrame | None, step: int) -> DataFrame:
        """The first free node from a hashed place on: among one place more than there are taken ones."""
        last = F.least(F.col("target_size") + F.coalesce("__taken", F.lit(0)), F.lit(n - 1))
        at = F.floor(hashed_uniform(F.lit(seed), prefix, F.lit(step)) * n)
        places = growing.join(taken, "complex_id", "left").withColumn("try", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn("idx", F.pmod(at + F.col("try"), F.lit(n)).cast("long"))
        rows = places.join(index.withColumnRenamed("node", "next"), "idx").join(banned, ["complex_id", "next"], "left_anti")
        if chosen is not None:
            rows = rows.join(chosen.select(*keys, F.col("node").alias("next")), [*keys, "next"], "left_anti")
        return rows.groupBy(*keys).agg(F.min_by("next", "try").alias("random_node"))

    specs = cut_lineage(specs.select(*keys, *[c for c in ("complex_id", "target_size") if c not in keys]))
    chosen = cut_lineage(specs.join(fresh(specs, None, 0), keys).select(*keys, *[c for c in specs.columns if c not in keys], F.col("random_node").alias("node")))
    known, newest = None, chosen
    for step in range(1, largest):
        growing = specs.filter(F.col("target_size") > step)
        # Only the nodes of the round before, one a candidate, look for their links: these few rows are sent out, the links stay where they are.
        asked = newest.filter(F.col("target_size") > step).select(*keys, *[c for c in ["complex_id"] if c not in keys], "node")
        fresh_links = asked.join(links.join(F.broadcast(asked.select("node").distinct()), "node", "left_semi"), "node").drop("node")
        open_links = fresh_links if known is None else known.join(growing.select(*keys), keys, "left_semi").unionByName(fresh_links)
        known = cut_lineage(open_links.distinct(), instead_of=known)
        frontier = known.join(chosen.select(*keys, F.col("node").alias("next")), [*keys, "next"], "left_anti")
        if filter_frontier:
            frontier = frontier.join(banned, ["complex_id", "next"], "left_anti")
        walk = frontier.groupBy(*keys).agg(F.min_by("next", F.struct(hashed(F.lit(seed), prefix, F.lit(step), F.col("next")), F.col("next"))).alias("walk"))
        jump = hashed_uniform(F.lit(seed + 1), prefix, F.lit(step)) <= restart
        both = growing.join(walk, keys, "left").join(fresh(growing, chosen, step), keys, "left")
        node = F.when(F.col("walk").isNull() | jump, F.coalesce("random_node", "walk")).otherwise(F.col("walk"))
        newest = cut_lineage(both.select(*specs.columns, node.alias("node")).filter("node is not null"))
        chosen = cut_lineage(chosen.union(newest))
    return chosen


def _controls_in_memory(edges: DataFrame, real: DataFrame, how: Controls, seed: int) -> DataFrame:
    """matched_controls for a graph of at most BROADCAST_EDGES edges, whose adjacency each worker holds; groups are worked on in parallel."""
    import numpy as np
    import pandas as pd

    from topograph.functions.controls import Adjacency, match
    from topograph.functions.grouped import map_groups

    rows = edges.select("a", "b", "w").filter("a <> b").toPandas()
    shared = edges.sparkSession.sparkContext.broadcast((rows["a"].to_numpy(str), rows["b"].to_numpy(str), rows["w"].to_numpy(np.float64)))
    held: list[Adjacency] = []

    def run(key: tuple, part: pd.DataFrame):
        if not held:
            held.append(Adjacency(*shared.value))
        graph = held[0]
        members = [graph.number[n] for n in part["node"] if n in graph.number]
        for control in range(how.per_group):
            nodes, score, targets = match(graph, members, how.attempts, how.restart, how.density_tolerance, how.degree_tolerance, seed, (key[0], control))
            yield from ((key[0], control, graph.words[v], score, *targets) for v in nodes)

    return map_groups(real.select("complex_id", "node"), ["complex_id"], run, "complex_id long, control int, node string, match_score double, target_density double, target_mean_degree double, target_mean_strength double", order=["node"])


def _controls_by_joins(edges: DataFrame, real: DataFrame, how: Controls, seed: int) -> DataFrame:
    """matched_controls with all attempts of all controls as rows of one plan."""
    keys = ["complex_id", "control", "attempt"]
    plain = edges.filter("a <> b")
    real = real.join(node_set(plain), "node", "left_semi")
    full = cut_lineage(degree_strength(plain).select("node", "degree"))
    mean_degree = real.join(full, "node").groupBy("complex_id").agg(F.avg("degree").alias("target_mean_degree"))
    basics = subgraph_basics(plain, real, ["complex_id"]).select("complex_id", F.col("num_nodes").cast("int").alias("target_size"), F.col("density").alias("target_density"), F.col("mean_strength").alias("target_mean_strength"))
    targets = cut_lineage(basics.join(mean_degree, "complex_id"))
    specs = targets.select("complex_id", "target_size").withColumn("control", F.explode(F.sequence(F.lit(0), F.lit(how.per_group - 1)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(how.attempts - 1))))
    grown = grow_candidates(plain, specs, keys, real.select("complex_id", "node"), seed, how.restart)
    own = subgraph_basics(plain, grown.select(*keys, "node"), keys).select(*keys, "density", "mean_strength").join(grown.join(full, "node").groupBy(*keys).agg(F.avg("degree").alias("mean_degree")), keys)
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(1.0))
    off = F.abs(F.col("density") - F.col("target_density"))
    scored = own.join(targets, "complex_id").withColumn("match_score", off + far("mean_degree", "target_mean_degree") + far("mean_strength", "target_mean_strength")).withColumn("accepted", (off <= how.density_tolerance) & (far("mean_degree", "target_mean_degree") <= how.degree_tolerance))
    # The first accepted attempt, else the one of the best score, of which the first.
    first = F.struct((~F.col("accepted")).alias("refused"), F.when(F.col("accepted"), 0.0).otherwise(F.col("match_score")).alias("score"), F.col("attempt"))
    picked = scored.groupBy("complex_id", "control").agg(F.min_by(F.struct("attempt", *TARGETS), first).alias("best")).select("complex_id", "control", "best.*")
    return grown.select(*keys, "node").join(picked, keys).drop("attempt")


def matched_controls(edges: DataFrame, real: DataFrame, how: Controls, seed: int) -> DataFrame:
    """real: complex_id, node. Controls (complex_id, control, node, score and targets) of the same sizes.

    The adjacency of a graph of checked size is sent to all workers; a larger one is walked by joins. Both grow the same
    candidates and pick the same ones.
    """
    small = edges.count() <= BROADCAST_EDGES
    return (_controls_in_memory if small else _controls_by_joins)(edges, real, how, seed)


def instance_members(edges: DataFrame, groups: DataFrame, sizes: Sizes, how: Controls, seed: int) -> DataFrame:
    """Real groups and their controls: complex_id, control (-1 for real), label, node, and the controls' targets."""
    inside = members_in_graph(groups, node_set(edges))
    chosen = eligible(groups, node_set(edges), sizes.smallest, sizes.largest, sizes.most).select("complex_id")
    real = cut_lineage(inside.join(chosen, "complex_id", "left_semi").select("complex_id", "node"))
    controls = matched_controls(edges, real, how, seed)
    none = [F.lit(None).cast("double").alias(t) for t in TARGETS]
    return real.select("complex_id", F.lit(-1).alias("control"), F.lit(1).alias("label"), "node", *none).union(controls.select("complex_id", "control", F.lit(0).alias("label"), "node", *TARGETS))


def instance_features(edges: DataFrame, instances: DataFrame, filtration: str, cap: int, seed: int, prefix: str | None = None, maxdim: int = 2) -> DataFrame:
    group = ["complex_id", "control"]
    facts = instances.groupBy(*group).agg(F.first("label").alias("label"), *[F.first(t).alias(t) for t in TARGETS])
    rows = subgraph_features(edges, instances.select(*group, "node"), group, filtration, cap, seed, prefix, maxdim)
    named = rows.join(facts, group).withColumn("size_bin", size_bin(F.col("full_num_nodes"))).withColumn("complex_group", F.concat(F.lit("group_"), F.col("complex_id").cast("string")))
    return named.withColumn("subgraph_id", F.when(F.col("label") == 1, F.concat_ws("_", F.lit("real_complex"), "complex_id")).otherwise(F.concat_ws("_", F.lit("matched_random"), "complex_id", "control")))


def complex_vs_random(edges: DataFrame, groups: DataFrame, config: DecisionConfig) -> tuple[DataFrame, DataFrame]:
    """Feature table of real and matched random subgraphs; metrics of graph features, persistence features and both."""
    instances = cut_lineage(instance_members(edges, groups, config.groups, config.controls, config.seed))
    table = cut_lineage(instance_features(edges, instances, "correlation_distance", config.node_cap, config.seed))
    ph = [c for c in table.columns if c.startswith("ph_")]
    models = {"baseline": SUBGRAPH_FEATURES, "ph": ph, "combined": [*SUBGRAPH_FEATURES, *ph]}
    seeds = {"baseline": config.seed, "ph": config.seed + 1, "combined": config.seed + 2}
    per = repeat_metrics(table, models, "subgraph_id", "label", config.splits, seeds, grouped_by="complex_group")
    return table, mean_metrics(per, list(models))


def null_controls(proteins: DataFrame, complexes: DataFrame, config: DecisionConfig, clean: bool = False) -> DataFrame:
    """Metrics after shuffling labels: of proteins over all rows, of subgraphs inside size bins.

    The subgraph control is fitted on every numeric column, also those that only controls have; clean leaves these out.
    """
    seed = config.seed
    shuffled = proteins.join(shuffle_labels(proteins, "protein", "protein_in_any_complex", seed), "protein")
    one = repeat_metrics(shuffled, {"protein_label_shuffle": PROTEIN_FEATURES}, "protein", "shuffled", config.splits, seed + 3)
    left_out = {"subgraph_id", "source", "label", "complex_group", "size_bin", "complex_id", "control", *(TARGETS if clean else [])}
    columns = [c for c in complexes.columns if c not in left_out]
    mixed = complexes.join(shuffle_labels(complexes, "subgraph_id", "label", seed, ["size_bin"]).select("subgraph_id", "shuffled"), "subgraph_id")
    two = repeat_metrics(mixed, {"complex_label_shuffle": columns}, "subgraph_id", "shuffled", config.splits, seed + 4, grouped_by="complex_group")
    return mean_metrics(one.union(two), ["protein_label_shuffle", "complex_label_shuffle"])


def verdict(coverage: Column, stability: Column, baseline: Column, ph: Column, combined: Column, null: Column) -> Column:
    off = F.abs(null - 0.5)
    covered = coverage >= 0.25
    go = covered & (stability >= 0.90) & (combined >= baseline + 0.05) & (ph >= baseline - 0.02) & (off <= 0.08)
    maybe = covered & (stability >= 0.80) & (combined >= baseline + 0.02) & (off <= 0.12)
    return F.when(go, "go").when(maybe, "conditional_go").otherwise("no_go")


def local_neighborhoods(edges: DataFrame, seeds: DataFrame, protocols: tuple[str, ...], caps: tuple[int, ...]) -> DataFrame:
    """protocol, max_nodes, seed, node."""
    out = None
    for protocol in protocols:
        widest = neighborhood(edges, seeds, protocol, max(caps))
        for cap in caps:  # ranks don't depend on the cap
            part = widest.filter(F.col("rank") < cap).select(F.lit(protocol).alias("protocol"), F.lit(cap).alias("max_nodes"), "seed", "node")
            out = part if out is None else out.union(part)
    return out


def local_ph(edges: DataFrame, proteins: DataFrame, config: ExplorationConfig) -> tuple[DataFrame, DataFrame]:
    """Do persistence features of bounded neighbourhoods tell members from others? Feature table and metrics."""
    chosen = cut_lineage(panel(proteins, "protein", "protein_in_any_complex", config.panel.positives, config.panel.negatives, config.seed))
    near = cut_lineage(local_neighborhoods(edges, chosen.select(F.col("protein").alias("seed")), ("top_weighted_neighbors",), (config.neighborhood_cap,)).select("seed", "node"))
    table, models, seeds = chosen, {"baseline": PROTEIN_FEATURES}, {"baseline": config.seed}
    for i, filtration in enumerate(config.filtrations):
        prefix = f"local_{filtration}"
        part = graph_ph_summary(edges, near, ["seed"], filtration, config.maxdim)
        ph = [c for c in part.columns if c.startswith("ph_")]
        table = table.join(part.select(F.col("seed").alias("protein"), *[F.col(c).alias(f"{prefix}_{c}") for c in ph]), "protein")
        named, at = [f"{prefix}_{c}" for c in ph], config.seed + 1 + 3 * i
        models |= {f"{filtration}:ph_only": named, f"{filtration}:baseline_plus_ph": [*PROTEIN_FEATURES, *named]}
        seeds |= {f"{filtration}:ph_only": at + 50, f"{filtration}:baseline_plus_ph": at + 100}
    table = cut_lineage(table)
    label = "protein_in_any_complex"
    per = repeat_metrics(table, models, "protein", label, config.splits, seeds, bounded=True)
    names = list(models)
    shuffled = table.join(shuffle_labels(table, "protein", label, config.seed), "protein")
    for i, filtration in enumerate(config.filtrations):
        name = f"{filtration}:label_shuffle_null"
        per = per.union(repeat_metrics(shuffled, {name: models[f"{filtration}:baseline_plus_ph"]}, "protein", "shuffled", config.splits, config.seed + 1 + 3 * i + 150, bounded=True))
        names.append(name)
    return table, mean_metrics(per, names)


def filtration_comparison(edges: DataFrame, groups: DataFrame, config: ExplorationConfig) -> DataFrame:
    """Real groups against controls under each filtration: persistence only, with graph features, and a shuffled control."""
    instances = cut_lineage(instance_members(edges, groups, config.groups, config.controls, config.seed))
    per, names = None, []
    for i, filtration in enumerate(config.filtrations):
        table = cut_lineage(instance_features(edges, instances, filtration, config.node_cap, config.seed, prefix=filtration))
        ph, at = [c for c in table.columns if c.startswith(f"{filtration}_ph_")], config.seed + 3 * i
        models = {f"{filtration}:ph_only": ph, f"{filtration}:baseline_plus_ph": [*SUBGRAPH_FEATURES, *ph]}
        got = repeat_metrics(table, models, "subgraph_id", "label", config.splits, {f"{filtration}:ph_only": at + 30, f"{filtration}:baseline_plus_ph": at + 60}, grouped_by="complex_group")
        mixed = table.join(shuffle_labels(table, "subgraph_id", "label", config.seed + i, ["size_bin"]).select("subgraph_id", "shuffled"), "subgraph_id")
        null = f"{filtration}:label_shuffle_null"
        got = got.union(repeat_metrics(mixed, {null: models[f"{filtration}:baseline_plus_ph"]}, "subgraph_id", "shuffled", config.splits, at + 90, grouped_by="complex_group"))
        per = got if per is None else per.union(got)
        names += [*models, null]
    return mean_metrics(per, names)


def protocol_sweep(edges: DataFrame, proteins: DataFrame, config: SweepConfig) -> DataFrame:
    """Every neighbourhood protocol and cap: persistence only, combined and shuffled; lift over the graph features.

    One job computes all persistence summaries, one grouped map fits all models.
    """
    label = "protein_in_any_complex"
    chosen = cut_lineage(panel(proteins, "protein", label, config.panel.positives, config.panel.negatives, config.seed))
    near = cut_lineage(local_neighborhoods(edges, chosen.select(F.col("protein").alias("seed")), config.protocols, config.neighborhood_caps))
    summary = cut_lineage(graph_ph_summary(edges, near, ["protocol", "max_nodes", "seed"], config.filtration, config.maxdim))
    ph = [c for c in summary.columns if c.startswith("ph_")]
    table = chosen.join(shuffle_labels(chosen, "protein", label, config.seed), "protein").join(summary.select(F.concat_ws(":", "protocol", "max_nodes").alias("part"), F.col("seed").alias("protein"), *ph), "protein")
    models, seeds, parts, labels = {"baseline": PROTEIN_FEATURES}, {"baseline": config.seed}, {}, {}
    heads = [f"{p}:{c}" for p in config.protocols for c in config.neighborhood_caps]
    for at, head in enumerate(heads):
        models |= {f"{head}:ph_only": ph, f"{head}:baseline_plus_ph": [*PROTEIN_FEATURES, *ph], f"{head}:label_shuffle_null": [*PROTEIN_FEATURES, *ph]}
        for k, kind in enumerate(("ph_only", "baseline_plus_ph", "label_shuffle_null")):
            seeds[f"{head}:{kind}"], parts[f"{head}:{kind}"] = config.seed + at + 40 * (k + 1), head
        labels[f"{head}:label_shuffle_null"] = "shuffled"
    base = repeat_metrics(chosen, {"baseline": PROTEIN_FEATURES}, "protein", label, config.splits, config.seed, bounded=True)
    own = {m: c for m, c in models.items() if m != "baseline"}
    per = base.union(repeat_metrics(table, own, "protein", label, config.splits, seeds, bounded=True, parts=("part", parts), labels=labels))
    means = cut_lineage(mean_metrics(per, list(models)))
    first = means.filter("model = 'baseline'").select(F.col("mean_auroc").alias("__base"))
    return means.join(F.broadcast(first)).withColumn("auroc_lift_vs_baseline", F.col("mean_auroc") - F.col("__base")).drop("__base")  # one row


def best_protocol(sweep: DataFrame) -> DataFrame:
    """The combined model of the largest lift."""
    return sweep.filter("model like '%:baseline_plus_ph'").orderBy(F.col("auroc_lift_vs_baseline").desc(), "model").limit(1)


__all__ = ["best_protocol", "complex_vs_random", "data_sanity", "filtration_comparison", "local_ph", "null_controls", "ph_stability", "protein_baseline", "protocol_sweep", "verdict"]
