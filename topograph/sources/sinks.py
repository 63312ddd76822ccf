"""Writing tables, reports and matrices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_json(data: dict) -> str:
    return json.dumps(data, indent=2, sort_keys=True)


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    """A report (bounded by its keys) as indented, sorted JSON; path may be in any store that Spark reaches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(to_json(data).encode("utf-8")))
    finally:
        out.close()


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; single writes one file, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def append_text(df: DataFrame, path: str) -> None:
    df.write.mode("append").text(path)


def compressed_rows(edges: DataFrame, repeated: bool = False) -> DataFrame:
    """The symmetric adjacency by rows: row, columns (rising) and values, numbered in the order of names. Absent cells aren't stored.

    repeated: a name stands for several nodes. Then each edge is stored in both directions, equal ones and loops too, as a sparse matrix holds entries that are to be added.
    """
    from topograph.operators.graph import node_set, symmetric
    from topograph.operators.sets import index_dictionary

    index = index_dictionary(node_set(edges))
    cells = symmetric(edges) if repeated else symmetric(edges).distinct()
    cells = cells.join(index, "node").withColumnRenamed("idx", "row").join(index.select(F.col("node").alias("nbr"), F.col("idx").alias("column")), "nbr")
    packed = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("column", F.coalesce("w", F.lit(1.0)).alias("value")))).alias("cells"))  # a row of the matrix: a node's degree
    return packed.select("row", F.transform("cells", lambda c: c["column"]).alias("columns"), F.transform("cells", lambda c: c["value"]).alias("values"))


def matrix_lines(rows: DataFrame, n: int) -> DataFrame:
    """rows of compressed_rows() as tab-separated text of n values a row (for small matrices)."""
    cell = lambda j: F.coalesce(F.element_at(F.map_from_arrays("columns", "values"), j.cast("long")), F.lit(0.0))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: cell(j).cast("string")), "\t")
    return rows.select("row", line.alias("value"))


def write_matrix(edges: DataFrame, path: str, dense: bool = False, repeated: bool = False) -> None:
    """The adjacency as compressed rows in Parquet, or as dense text, a line per row. repeated: as compressed_rows() says."""
    rows = compressed_rows(edges, repeated)
    if dense:
        matrix_lines(rows, rows.count()).repartitionByRange("row").sortWithinPartitions("row").select("value").write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def rips_summary_line(dimension: int, simplices: int, vertices: int) -> str:
    return f"Rips complex is of dimension {dimension} - {simplices} simplices - {vertices} vertices."

