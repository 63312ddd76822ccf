"""Text blocks that ask a distributed index about their keys.

The documents are cut into blocks of a few megabytes, written to the shared folder bucketed by block.  A block
asks about each of its distinct 64-bit keys once: sorted, split over the index's buckets by a second,
independent hash, and packed.  An index bucket sees the asks of all blocks for its keys, so it can sum or
compare over the whole corpus, and answers every block in the order of its keys.  Only packed keys and answers
are shuffled, never the texts: a block finds its answers where its texts already are.

A key asked by every block, or held by a third of all rows, is one entry per block.  The number of index buckets
follows the input, so a bucket's keys fit a worker at any size; a task works through its buckets one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.common import input_bytes, materialize_bucketed, partitions, pick

#: Text bytes of a block: about a quarter of a partition's share, within these bounds.
BLOCK_BYTES = (1 << 20, 32 << 20)
#: Text bytes whose keys an index bucket holds, on average.
BUCKET_BYTES = 16 << 20
#: Bytes of text for a byte of Parquet with usual and with zstd compression, roughly: only sizes of blocks and buckets depend on them.
UNPACKED, UNPACKED_ZSTD = 1.7, 2.5
ASKS = "block long, bucket int, keys binary, values binary"


@dataclass
class Blocks:
    """The columns asked for, then block and place (in the block), bucketed by block; and how many index buckets there are."""

    rows: DataFrame
    buckets: int


def cut(docs: DataFrame, columns: list[str], text_column: str, name: str) -> Blocks:
    """docs' columns cut into blocks, in the shared folder. Columns keep their places, not their names."""
    spark = docs.sparkSession
    slim = pick(docs, *columns).toDF(*[f"column_{i}" for i in range(len(columns))])
    at, parts, size = columns.index(text_column), partitions(spark), input_bytes(slim) * UNPACKED
    block_bytes = int(min(max(size / (4 * parts), BLOCK_BYTES[0]), BLOCK_BYTES[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, size, place = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in batches:
            blocks, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int32)
            for i, n in enumerate(_lengths(batch.column(at))):
                if size and size + n > block_bytes:
                    number, size, place = number + 1, 0, 0
                size += n
                blocks[i], places[i] = first + number, place
                place += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks), pa.array(places)], names=[*batch.schema.names, "block", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    rows = materialize_bucketed(slim.mapInArrow(run, f"{schema}, block long, place int"), name, "block", parts)
    return Blocks(rows, max(parts, int(input_bytes(rows) * UNPACKED_ZSTD // BUCKET_BYTES) + 1))


def _lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """64-bit integers as byte planes, so that the planes of unused high bytes vanish under compression."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    if delta and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(values, dtype=np.uint64) if delta else values


def split(keys: np.ndarray, second: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Positions of sorted keys by index bucket; within a bucket in the order of the keys."""
    bucket = (second % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))


def ask(blocks: Blocks, gather: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """gather(table of a block) -> sorted distinct keys, their second hashes, and value columns."""
    buckets = blocks.buckets

    def run(block: pa.Table) -> pa.Table:
        keys, second, values = gather(block)
        own, rows = block.column("block")[0].as_py(), []
        for bucket, at in enumerate(split(keys, second, buckets)):
            if len(at):
                rows.append((own, bucket, pack(keys[at], delta=True), pack(np.concatenate([v[at].astype(np.uint64) for v in values])) if values else b""))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "keys", "values"])

    return blocks.rows.groupBy("block").applyInArrow(run, ASKS)


def answer(asks: DataFrame, resolve: Callable[[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray], tuple[list[tuple[list[np.ndarray], np.ndarray | None]], np.ndarray]], n_values: int, n_answers: int = 1) -> DataFrame:
    """resolve(keys, block of each key, value columns, block numbers) -> answers, and three totals of the bucket.

    An answer is a list of columns and a mask of the keys that it covers (None: all).  A row per block and bucket, with each
    answer packed in a column of its own; the totals are in a row without a block.
    """
    names = [f"answer_{i}" for i in range(n_answers)]

    def run(bucket: pa.Table) -> pa.Table:
        blocks = bucket.column("block").to_numpy()
        keys = [unpack(k.as_py(), delta=True) for k in bucket.column("keys")]
        sizes = np.array([len(k) for k in keys])
        values = [unpack(v.as_py()).reshape(n_values, -1) for v in bucket.column("values")] if n_values else []
        columns = [np.concatenate([v[i] for v in values]) for i in range(n_values)]
        got, totals = resolve(np.concatenate(keys), np.repeat(np.arange(len(blocks)), sizes), columns, blocks)
        ends = np.cumsum(sizes).tolist()
        packed = {}
        for name, (parts, mask) in zip(names, got):
            at = [slice(e - n, e) if mask is None else np.arange(e - n, e)[mask[e - n : e]] for e, n in zip(ends, sizes.tolist())]
            packed[name] = pa.array([*[pack(np.concatenate([g[i].astype(np.uint64) for g in parts])) for i in at], None], pa.binary())
        own, n = bucket.column("bucket")[0].as_py(), len(blocks)
        return pa.table({
            "block": pa.array([*blocks.tolist(), None], pa.int64()), "bucket": pa.array([own] * (n + 1), pa.int32()), **packed,
            **{f"total_{i}": pa.array([None] * n + [int(totals[i])], pa.int64()) for i in range(3)},
        })

    return asks.groupBy("bucket").applyInArrow(run, f"block long, bucket int, {', '.join(f'{n} binary' for n in names)}, total_0 long, total_1 long, total_2 long")


def answered(answers: pa.Table, keys: np.ndarray, second: np.ndarray, buckets: int, n_columns: int, mask: np.ndarray | None = None) -> list[np.ndarray]:
    """The columns of an answer in the order of a block's keys; mask marks the keys that the answer covers."""
    out = [np.zeros(len(keys), np.uint64) for _ in range(n_columns)]
    parts = split(keys, second, buckets)
    for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("answer")):
        at = parts[bucket] if mask is None else parts[bucket][mask[parts[bucket]]]
        for column, values in zip(out, unpack(data.as_py()).reshape(n_columns, -1)):
            column[at] = values
    return out


def finish(blocks: Blocks, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, which: int = 0) -> DataFrame:
    """run(texts of a block, one of its answers) for every block, where the texts are."""
    return blocks.rows.groupBy("block").cogroup(answers.filter(F.col("block").isNotNull()).select("block", "bucket", F.col(f"answer_{which}").alias("answer")).groupBy("block")).applyInArrow(run, schema)
