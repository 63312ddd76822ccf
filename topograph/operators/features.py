"""Feature tables of nodes and of subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.functions.lineage import cut_lineage
from topograph.operators.components import subgraph_components
from topograph.operators.graph import degree_strength, density, induced_edges, node_features, node_set
from topograph.operators.homology import bars_and_sums, diagram_summary, sample_for_ph
from topograph.operators.filtration import with_members
from topograph.operators.ranking import ratio
from topograph.operators.sets import coverage, members_in_graph, membership_counts
from topograph.schema import PH_COLUMNS


def size_bin(size: Column) -> Column:
    return F.when(size <= 4, "small").when(size <= 8, "medium").otherwise("large")


def coverage_summary(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    per = coverage(groups, nodes)
    return per.agg(
        F.count(F.lit(1)).cast("double").alias("num_complexes"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_complex_size"),
        F.coalesce(F.avg(F.col("covered").cast("double")), F.lit(0.0)).alias("fraction_complexes_fully_covered"),
        F.coalesce(ratio(F.sum("observed").cast("double"), F.sum("size").cast("double")), F.lit(0.0)).alias("fraction_complex_members_observed"),
    )


def degree_baseline(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """protein, degree, complex_membership_count, most memberships first."""
    counts = membership_counts(groups).withColumnsRenamed({"member": "node"})
    rows = degree_strength(edges).join(counts, "node", "left")
    return rows.select(F.col("node").alias("protein"), "degree", F.coalesce("n_memberships", F.lit(0)).alias("complex_membership_count")).orderBy(F.col("complex_membership_count").desc(), F.col("degree").desc(), "protein")


def protein_features(edges: DataFrame, groups: DataFrame, repeated: bool = False) -> DataFrame:
    """One row per node, by name: degree, strength, clustering, ego size and density, memberships. repeated: as graph.triangles_per_node() says."""
    rows = node_features(edges, repeated=repeated).join(membership_counts(groups).withColumnRenamed("member", "node"), "node", "left")
    n, m = F.col("degree") + 1, F.col("degree") + F.col("triangles")
    count = F.coalesce("n_memberships", F.lit(0))
    return rows.select(F.col("node").alias("protein"), "degree", "strength", "clustering", n.alias("ego_nodes"), m.alias("ego_edges"), density(n, m).alias("local_density"), count.alias("complex_membership_count"), (count > 0).cast("int").alias("protein_in_any_complex")).orderBy("protein")


def subgraph_basics(edges: DataFrame, members: DataFrame, group: list[str], repeated: bool = False, inside: DataFrame | None = None) -> DataFrame:
    """num_nodes, num_edges, density, mean degree, strength and clustering of every induced subgraph. inside: its edges, where they are known."""
    if inside is None:
        inside = cut_lineage(induced_edges(edges, members.select(*group, "node"), group))  # six plans read it
    per_node = node_features(inside, group, repeated).groupBy(*group).agg(F.sum("degree").alias("sd"), F.sum("strength").alias("ss"), F.sum("clustering").alias("sc"))
    rows = members.groupBy(*group).agg(F.count(F.lit(1)).alias("num_nodes")).join(inside.groupBy(*group).agg(F.count(F.lit(1)).alias("m")), group, "left").join(per_node, group, "left")
    mean = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("num_nodes")
    m = F.coalesce("m", F.lit(0))
    return rows.select(*group, "num_nodes", m.cast("long").alias("num_edges"), density(F.col("num_nodes"), m).alias("density"), mean("sd").alias("mean_degree"), mean("ss").alias("mean_strength"), mean("sc").alias("mean_clustering"))


def graph_ph_summary(edges: DataFrame, members: DataFrame, group: list[str], filtration: str = "correlation_distance", maxdim: int = 2, inside: DataFrame | None = None) -> DataFrame:
    """The persistence summary, the graph's size (as double) and the mean and deviation over all n * n distances. inside: the edges of the subgraphs, where they are known."""
    if inside is None:
        members = cut_lineage(members)
        inside = cut_lineage(induced_edges(edges, members.select(*group, "node"), group))
    found = cut_lineage(bars_and_sums(with_members(edges, members, group, inside), group, filtration, maxdim))
    summary = diagram_summary(found.drop("s1", "s2"), group, members)
    d = found.filter("s1 is not null").select(*group, "s1", "s2")  # a row a group
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    edged = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    cells = F.col("n").cast("double") * F.col("n")
    mean = F.coalesce(F.col("s1"), F.lit(0.0)) / cells
    spread = F.sqrt(F.greatest(F.coalesce(F.col("s2"), F.lit(0.0)) / cells - mean * mean, F.lit(0.0)))
    rows = summary.join(sizes, group).join(edged, group, "left").join(d, group, "left")
    return rows.select(*group, *PH_COLUMNS, F.col("n").cast("double").alias("num_nodes"), F.coalesce("m", F.lit(0)).cast("double").alias("num_edges"), mean.alias("distance_matrix_mean"), spread.alias("distance_matrix_std"))


def subgraph_features(edges: DataFrame, members: DataFrame, group: list[str], filtration: str = "correlation_distance", cap: int | None = None, seed: int = 7, prefix: str | None = None, maxdim: int = 2, repeated: bool = False) -> DataFrame:
    """Basic features with the persistence summary of the (sampled) subgraph, whose size replaces num_nodes and num_edges; the whole one's stay as full_*.

    The edges inside the subgraphs are looked up once for all parts.
    """
    members = cut_lineage(members)
    inside = cut_lineage(induced_edges(edges, members.select(*group, "node"), group))
    sampled = sample_for_ph(edges, members, group, cap, seed, inside=inside) if cap else members
    basics = subgraph_basics(edges, members, group, repeated, inside).withColumnsRenamed({"num_nodes": "full_num_nodes", "num_edges": "full_num_edges"})
    parts = subgraph_components(edges, members, group, inside).withColumnRenamed("n_components", "num_connected_components")
    whole = sampled is members
    ph = graph_ph_summary(edges, sampled, group, filtration, maxdim, inside if whole else None).withColumn("ph_num_nodes_used", F.col("num_nodes"))
    out = basics.join(parts, group).join(ph, group)
    return out.withColumnsRenamed({c: f"{prefix}_{c}" for c in out.columns if c.startswith("ph_")}) if prefix else out


def complex_features(edges: DataFrame, groups: DataFrame, source: str, smallest: int = 3, **options) -> DataFrame:
    """subgraph_features of every group with enough members in the graph."""
    members = members_in_graph(groups, node_set(edges))
    big = members.groupBy("complex_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= smallest).select("complex_id")
    rows = subgraph_features(edges, members.join(big, "complex_id", "left_semi"), ["complex_id"], **options)
    return rows.withColumn("subgraph_id", F.concat(F.lit(f"{source}_"), F.col("complex_id").cast("string"))).withColumn("source", F.lit(source)).withColumn("label", F.lit(int(source == "real_complex")))


def data_sanity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Nine figures of the input in one row."""
    from topograph.operators.sets import group_sizes

    degree = degree_strength(edges).join(membership_counts(groups).withColumnRenamed("member", "node"), "node", "left")
    inside = F.col("n_memberships").isNotNull()
    nodes = node_set(edges)
    per_node = degree.agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.coalesce(F.avg(F.when(inside, F.col("degree"))), F.lit(0.0)).alias("mean_degree_in_complexes"),
        F.coalesce(F.avg(F.when(~inside, F.col("degree"))), F.lit(0.0)).alias("mean_degree_outside_complexes"),
    )
    per_group = group_sizes(groups).agg(F.count(F.lit(1)).alias("num_complexes"), F.avg("size").alias("mean_complex_size"), F.median("size").alias("median_complex_size"))
    covered = coverage(groups, nodes).agg(F.sum(F.col("covered").cast("long")).alias("num_fully_covered"), F.avg(F.col("covered").cast("double")).alias("complex_coverage"))
    one = lambda df: df.withColumn("k", F.lit(1))
    out = one(per_node)
    for part in (per_group, covered, edges.agg(F.count(F.lit(1)).alias("num_edges"))):
        out = out.join(one(part), "k")
    return out.drop("k")
