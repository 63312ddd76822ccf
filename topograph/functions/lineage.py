"""Cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes a query's shuffle files when it ends; else they stay until the driver's garbage is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_root:
        _own_root[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="topograph-")
        _written.append((spark, _own_root[sc.applicationId]))
    return _own_root[sc.applicationId]


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at exit."""
    path = f"{shared_root(spark)}/topograph-tables/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df, computed once and read from a table: what follows plans over a scan, however deep the plan before was.

    A table rather than a checkpoint, as what the planner infers about a checkpoint's rows is carried on and doubles in every round of
    a loop. The shuffle files of the write go with it: nothing reads them again. instead_of: an earlier result that df replaces; its files are deleted once df is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if instead_of is not None:
        drop_tables(spark, instead_of._written_to)
    return out


def drop_tables(spark: SparkSession | None = None, path: str | None = None) -> None:
    """Deletes what cut_lineage() has written, all of a session's or one table; results that still read it must have been written before."""
    for own, at in list(_written):
        if (spark is None or own is spark) and path in (None, at):
            _written.remove((own, at))
            try:
                target = own._jvm.org.apache.hadoop.fs.Path(at)
                target.getFileSystem(own._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # the session has ended: nothing is left to ask
                continue


atexit.register(drop_tables)
