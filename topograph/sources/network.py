"""Reading edge lists and node groups.

Edges have columns ProteinA, ProteinB, SemSim and ord (position in the input, which decides between repeated
pairs); groups have complex_id, pos and member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topograph.schema import EDGE_FILE, PAIR_FILE


def read_edges(spark: SparkSession, path: str, header: bool = False, weighted: bool = True, sep: str = "\t") -> DataFrame:
    """A tab-separated edge list; unweighted lists get null weights. A header's own names are replaced."""
    rows = spark.read.schema(EDGE_FILE if weighted else PAIR_FILE).option("sep", sep).option("header", header).option("enforceSchema", True).csv(path)
    if not weighted:
        rows = rows.withColumn("SemSim", F.lit(None).cast("double"))
    return rows.withColumn("ord", F.monotonically_increasing_id())


def read_complexes(spark: SparkSession, path: str, delimiter: str = "\t", keep_empty: bool = False) -> DataFrame:
    """A group per line. keep_empty keeps empty names and lines, as older inputs need; delimiter is a regular expression."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    tokens = lines.select("line", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), delimiter).alias("members"))
    if not keep_empty:
        tokens = tokens.withColumn("members", F.filter("members", lambda m: m != "")).filter(F.size("members") > 0)
    # Line numbers rise with the file; dense ids come from counts per split, not from one sorted task.
    tokens = tokens.withColumn("part", F.shiftright("line", 33))
    counts = tokens.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.join(counts.select(F.col("part").alias("q"), F.col("n").alias("m")), F.col("q") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("line")) - 1
    return tokens.withColumn("at", at).join(before, "part").select((F.col("before") + F.col("at")).alias("complex_id"), F.posexplode("members").alias("pos", "member"))


def toy_network(spark: SparkSession) -> DataFrame:
    """A six-edge weighted graph for examples and tests."""
    rows = [("A", "B", 0.9), ("A", "C", 0.8), ("A", "D", 0.2), ("B", "C", 0.7), ("C", "E", 0.85), ("D", "F", 0.95)]
    return spark.createDataFrame([(a, b, w, i) for i, (a, b, w) in enumerate(rows)], "ProteinA string, ProteinB string, SemSim double, ord long")


# A published toy network with its groups.
TOY_EDGES = [
    ("A", "B", 0.8), ("A", "C", 0.9), ("B", "C", 0.8), ("B", "D", 0.5), ("C", "E", 0.5), ("D", "F", 0.6), ("D", "G", 0.7), ("E", "H", 0.8), ("F", "I", 0.9), ("G", "J", 0.8),
    ("H", "K", 0.6), ("I", "L", 0.5), ("J", "M", 0.7), ("K", "N", 0.6), ("L", "O", 0.9), ("M", "P", 0.8), ("N", "Q", 0.5), ("O", "A", 0.6), ("P", "B", 0.7), ("Q", "C", 0.8),
]
TOY_GROUPS = [["A", "B", "C"], ["D", "E", "F"], ["G", "H", "I", "J"], ["K", "L"], ["M", "N", "O"], ["P", "Q"]]


def toy_benchmark(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The 20-edge network and its six groups: edges as read_edges() gives them, groups as read_complexes() does."""
    edges = [(a, b, w, i) for i, (a, b, w) in enumerate(TOY_EDGES)]
    groups = [(i, p, m) for i, g in enumerate(TOY_GROUPS) for p, m in enumerate(g)]
    return spark.createDataFrame(edges, "ProteinA string, ProteinB string, SemSim double, ord long"), spark.createDataFrame(groups, "complex_id long, pos int, member string")
