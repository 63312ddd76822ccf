"""Shared pieces: table access, the shared scratch folder, and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []
_own_root: dict[str, str] = {}


#: Most bytes of an Arrow batch on its way to a Python worker; rows of any length still pass, one at a time.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, as a row count alone bounds nothing where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session without it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_root:
        _own_root[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="topograph-")
    return _own_root[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/topograph/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives the loss of any executor."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like materialize(), with the rows bucketed by a column, so that later grouping by it needs no shuffle."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    known = f"topograph_{name}_{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).format("parquet").saveAsTable(known))
    return spark.table(known)


def drop_scratch(spark: SparkSession | None = None) -> None:
    """Deletes what materialize() has left; results that still read it must have been written before."""
    for own, path in list(_made):
        if spark is None or own is spark:
            _made.remove((own, path))
            try:
                target = own._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(own._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # the session has ended: nothing is left to ask
                continue


atexit.register(drop_scratch)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file sizes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def without_space(text: Column) -> Column:
    return F.translate(text, WS, "")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of an input can't clash with those added later."""
    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def pack(df: DataFrame, *named: str) -> DataFrame:
    """The named columns as __p0, __p1, ..., and the others in one struct, so that none can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return df.select(*[F.col(f"`{n}`").alias(f"__p{i}") for i, n in enumerate(named)], F.struct(F.lit(True).alias("__any"), *rest).alias("__rest"))


def unpack(df: DataFrame, columns: list[str], *named: str) -> DataFrame:
    """The columns of the frame that was packed, in their order."""
    at = {n: f"__p{i}" for i, n in enumerate(named)}
    return df.select(*[(F.col(at[c]) if c in at else F.col("__rest").getField(c)).alias(c) for c in columns])
