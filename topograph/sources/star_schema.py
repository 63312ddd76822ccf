"""A network derived from a star schema: parts are nodes, orders are groups, co-ordered parts of finished orders are edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_name(key: Column) -> Column:
    return F.concat(F.lit("P"), F.lpad(key.cast("string"), 6, "0"))


#: Lines that a task joins at once; AQE would give a task as many as the cores leave, so its memory would grow with the table.
TASK_LINES = 100_000


def keyed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the parts' keys: pa < pb with weight w."""
    items = table(spark, sf_dir, "lineitem")
    parts = items.count() // TASK_LINES + 1
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").repartition(parts, "o_orderkey")
    lines = items.select("l_orderkey", "l_partkey", "l_discount").repartition(parts, "l_orderkey").join(finished, F.col("l_orderkey") == F.col("o_orderkey"))
    per_part = lines.groupBy(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).agg(F.min("l_discount").alias("d"))
    left, right = per_part.select("k", F.col("p").alias("pa"), F.col("d").alias("da")), per_part.select("k", F.col("p").alias("pb"), F.col("d").alias("db"))
    mean = F.avg(5 * (F.col("da") + F.col("db")))
    met = left.join(right, "k").filter("pa < pb").repartition(parts, "pa", "pb")  # hardly any pair meets twice: sums before this would hold every pair
    return met.groupBy("pa", "pb").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 6).alias("w"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical edges a < b with weight w. Names have six digits, so parts from 1,000,000 on share names."""
    return keyed_edges(spark, sf_dir).select(part_name(F.col("pa")).alias("a"), part_name(F.col("pb")).alias("b"), "w")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """complex_id, member, pos: the distinct parts of every order, by name."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("complex_id"), part_name(F.col("l_partkey")).alias("member")).distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("complex_id").orderBy("member")) - 1)
