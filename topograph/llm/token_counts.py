"""Token counts through a digest cache.

The digest of a text's normalised content is joined with stored counts under the tokenizer's version
digest; only distinct misses are encoded, and their counts are appended to the cache.  Content is
normalised by the tokenizer's own first step: every run of ASCII white space is one space, and outer
white space goes, which changes no count of a tokenizer that drops white space.

Null texts count as empty (0 bytes, 0 tokens).  Repeated rows and copies share one digest and one
encoding; contents of very many rows are a bounded list, and their rows are joined where they are.  Texts are encoded whole; a text of any length is one row of the miss set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.common import materialize, pick, scratch_path

CACHE = "tokenizer_digest binary, content_digest binary, n_tokens long"
#: Contents with more rows than so many, and than the table's rows divided by MAX_HOT, are hot: at most MAX_HOT, whose counts are broadcast.
HOT_ROWS, MAX_HOT = 256, 10_000
#: Chunks of a generation that a worker remembers (the one before is kept too, so frequent ones stay), and bytes of a chunk.
MEMO_ENTRIES, MEMO_CHUNK = 400_000, 64


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


class ChunkCounter:
    """Counts tokens of texts for tokenizers to which ASCII white space is a boundary that leaves no token."""

    def __init__(self, path: str):
        self.memo: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.library, self.whole = sentencepiece.SentencePieceProcessor(model_file=path), True
            self._counts = lambda texts: [len(ids) for ids in self.library.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            size = lambda text: len(self.library.encode(text, add_special_tokens=False).ids)
            self.whole = size("a  b\n") != size("a") + size("b")
            self._counts = lambda texts: [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[bytes]) -> list[int]:
        if self.whole:
            return self._counts([t.decode("utf-8") for t in texts])
        if len(self.memo) > MEMO_ENTRIES:
            self.memo, self.before = {}, self.memo
        split, memo, before = [t.split() for t in texts], self.memo, self.before
        new = {c for chunks in split for c in chunks}.difference(memo)
        memo.update((c, before[c]) for c in new if c in before)
        misses = [c for c in new if c not in memo]
        for at in range(0, len(misses), 10_000):
            some = misses[at : at + 10_000]
            memo.update(zip(some, self._counts([m.decode("utf-8") for m in some])))
        out = [sum(map(memo.__getitem__, chunks)) for chunks in split]
        for c in misses:
            if len(c) > MEMO_CHUNK:
                del memo[c]
        return out


@lru_cache(maxsize=1)
def counter_for(path: str, version: bytes) -> ChunkCounter:
    """One per worker process, so that tasks share the tokenizer and the remembered chunks."""
    return ChunkCounter(path)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _normal(text: bytes, whole: bool) -> bytes:
    return text if whole else b" ".join(text.split())


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit.  cache_path: Parquet folder of stored counts, read if it is there and appended to."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    whole = ChunkCounter(tokenizer_path).whole
    slim = pick(docs, id_column, text_column)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({
                id_column: batch.column(0),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "content_digest": pa.array([hashlib.sha256(_normal(t, whole)).digest() for t in texts], pa.binary()),
            })

    id_type = slim.schema[0].dataType.simpleString()
    rows = materialize(slim.mapInArrow(digests, f"`{id_column}` {id_type}, n_bytes long, content_digest binary"), "digests")

    cache = _cache(spark, cache_path).filter(F.col("tokenizer_digest") == F.lit(bytearray(version)))
    stored = cache.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = materialize(rows.groupBy("content_digest").agg(F.count(F.lit(1)).alias("n_rows")), "contents")
    misses = sizes.select("content_digest").join(stored, "content_digest", "left_anti")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct content of the task once, compressed for the shuffle."""
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in _pieces(batches):
            keys, packed = [], []
            for text in pc.fill_null(batch.column(0), "").cast(pa.binary()).to_pylist():
                if (key := hashlib.sha256(body := _normal(text, whole)).digest()) not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(press.compress(body))
            yield pa.RecordBatch.from_pydict({"content_digest": pa.array(keys, pa.binary()), "body": pa.array(packed, pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, unpress, before = counter_for(tokenizer_path, version), zstandard.ZstdDecompressor(), None
        for batch in _pieces(batches):
            keys, texts, size = [], [], 0
            out: list[tuple[list[bytes], list[int]]] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != before:
                    before = key
                    keys.append(key)
                    texts.append(unpress.decompress(body.as_py()))
                    size += len(texts[-1])
                    if size > 1 << 20:
                        out.append((keys, counter.counts(texts)))
                        keys, texts, size = [], [], 0
            out.append((keys, counter.counts(texts)))
            yield pa.RecordBatch.from_pydict({
                "tokenizer_digest": pa.array([version] * sum(len(k) for k, _ in out), pa.binary()),
                "content_digest": pa.array([k for ks, _ in out for k in ks], pa.binary()),
                "n_tokens": pa.array([n for _, ns in out for n in ns], pa.int64()),
            })

    texts = pick(slim, text_column).mapInArrow(bodies, "content_digest binary, body binary")
    wanted = texts.join(misses, "content_digest", "left_semi")
    new = wanted.repartition("content_digest").sortWithinPartitions("content_digest").mapInArrow(encode, CACHE)
    path = cache_path or scratch_path(spark, "token-cache")
    new.write.mode("append").option("compression", "zstd").parquet(path)
    counts = spark.read.schema(CACHE).parquet(path).filter(F.col("tokenizer_digest") == F.lit(bytearray(version))).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialize(counts.join(sizes, "content_digest"), "counts")
    # A content of many rows would fill one task of a join by digest.
    n_rows = sizes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("n_rows") > max(HOT_ROWS, n_rows // MAX_HOT)
    marked = rows.join(F.broadcast(counts.filter(is_hot).select("content_digest", F.col("n_tokens").alias("hot"))), "content_digest", "left")
    cold = marked.filter("hot is null").join(counts.filter(~is_hot).select("content_digest", "n_tokens"), "content_digest").select(id_column, "n_bytes", "n_tokens")
    every = cold.union(marked.filter("hot is not null").select(id_column, "n_bytes", F.col("hot").alias("n_tokens")))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)


def _cache(spark, path: str | None) -> DataFrame:
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return spark.read.schema(CACHE).parquet(path)
    return spark.createDataFrame([], CACHE)
