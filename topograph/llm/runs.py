"""Runs of equal keys in a table that is range-partitioned and sorted.

Sampled splitters deal the rows out by (prefix and hash of the key, order); each task sorts its range externally,
in the same order and then by the whole key, so equal keys are neighbours and a comparison of each row with the one before finds the runs.  A key may fill many
ranges: the splitters also cut inside a run, and the pieces are put together from two boundary rows per
range.  No task ever holds a whole group; a task keeps the rows of the run it is in (one of them where only heads are wanted), without their keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topograph.llm.common import materialize

#: Characters of a key that order it before its hash does.
PREFIX = 32
ADDED = "run_head {head}, run_size long, is_head boolean, key_sha256 string, __part int, __first boolean, __last boolean"


class _Marker:
    """Marks the runs of one task's sorted rows; the key is the last column of each batch."""

    def __init__(self, part: int, head_at: int, heads_only: bool):
        self.part, self.head_at, self.heads_only = part, head_at, heads_only
        self.key: pa.Scalar | None = None
        self.begun = 0  # runs begun so far
        self.open: list[pa.RecordBatch] = []
        self.size, self.sha = 0, ""

    def _rows(self, rows: pa.RecordBatch, head, size, is_head: np.ndarray, sha, first: np.ndarray, last: bool) -> pa.RecordBatch:
        n = rows.num_rows
        added = [head, pa.array(size, pa.int64()), pa.array(is_head), sha, pa.array(np.full(n, self.part, np.int32)), pa.array(first), pa.array(np.full(n, last))]
        names = ["run_head", "run_size", "is_head", "key_sha256", "__part", "__first", "__last"]
        return pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, *names])

    def _close(self, last: bool) -> Iterator[pa.RecordBatch]:
        for i, rows in enumerate(self.open):
            n = rows.num_rows
            head = pa.array([self.head] * n, rows.column(self.head_at).type)
            is_head = np.zeros(n, bool)
            is_head[0] = i == 0
            yield self._rows(rows, head, np.full(n, self.size), is_head, pa.array([self.sha] * n, pa.string()), np.full(n, self.begun == 1), last)
        self.open = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, k = batch.num_rows, batch.num_columns - 1
        if not n:
            return
        keys, rows = batch.column(k), batch.select(range(k))
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = self.key is None or keys[0] != self.key
        self.key = keys[n - 1]
        starts = np.flatnonzero(new)
        until = int(starts[0]) if len(starts) else n
        if until:  # the open run goes on
            self.size += until
            if not self.heads_only:
                self.open.append(rows.slice(0, until))
        if not len(starts):
            return
        if self.begun:
            yield from self._close(False)
        final = int(starts[-1])
        if final > until:
            inner = starts[:-1] - until
            lengths = np.diff(np.append(inner, final - until))
            body = rows.slice(until, final - until)
            shas = pa.array([hashlib.sha256(keys[int(a)].as_buffer()).hexdigest() for a in starts[:-1]], pa.string())
            of = np.repeat(np.arange(len(inner)), lengths)
            first = (of == 0) & (self.begun == 0)
            found = self._rows(body, body.column(self.head_at).take(pa.array(inner[of])), lengths[of], new[until:final], shas.take(pa.array(of)), first, False)
            yield found.take(pa.array(inner)) if self.heads_only else found
        self.begun += len(starts)
        self.open, self.size = [rows.slice(final, 1) if self.heads_only else rows.slice(final)], n - final
        self.head = rows.column(self.head_at)[final].as_py()
        self.sha = hashlib.sha256(keys[final].as_buffer()).hexdigest()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.begun:
            yield from self._close(True)


def equal_runs(df: DataFrame, key: Column, order: list[Column], head: str, name: str = "runs", drop: list[str] | None = None, heads_only: bool = False) -> DataFrame:
    """The rows of df with run_head (column head of the first row of the row's run), run_size, is_head and key_sha256.

    Rows are equal when their keys are identical (a string or binary without nulls).  order sorts the rows of a run; the
    first is its head.  drop names columns that only the key needs.  heads_only leaves out rows that are not the first of
their run in their range, so a task holds one row however large a run is.  The result is read from the shared folder.
    """
    drop = drop or []
    kept = [f for f in df.schema.fields if f.name not in drop]
    head_at = [f.name for f in kept].index(head)
    # Splitters are sampled on the driver: they hold a prefix and a hash of the key, not keys of any length.
    short, number = F.substring(key, 1, PREFIX), F.xxhash64(key)
    ranged = df.repartitionByRange(short, number, *order).withColumns({"__short": short, "__number": number, "__key": key}).drop(*drop)
    ranged = ranged.sortWithinPartitions("__short", "__number", "__key", *order).drop("__short", "__number")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = _Marker(TaskContext.get().partitionId(), head_at, heads_only)
        for batch in batches:
            yield from marker.add(batch)
        yield from marker.end()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ADDED.format(head=kept[head_at].dataType.simpleString())])
    out = materialize(ranged.mapInArrow(mark, schema), name)
    # A piece of a run that goes on in the next range is the last of its own and the first of that one: at most two pieces a range.
    pieces = (
        out.filter("is_head and (__first or __last)")
        .groupBy("key_sha256")
        .agg(F.min_by("run_head", "__part").alias("__head"), F.sum("run_size").alias("__size"), F.min("__part").alias("__from"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1")
        .drop("__n")
    )
    whole = F.col("__from").isNull()
    return out.join(F.broadcast(pieces), "key_sha256", "left").select(
        *[F.col(f"`{f.name}`") for f in kept],
        F.when(whole, F.col("run_head")).otherwise(F.col("__head")).alias("run_head"),
        F.coalesce("__size", "run_size").alias("run_size"),
        (F.col("is_head") & (whole | (F.col("__from") == F.col("__part")))).alias("is_head"),
        "key_sha256",
    )
