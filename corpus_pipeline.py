"""Documents to training tokens: quality rules, exact dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of docs.  Every stage runs over all rows of its input; an
empty table passes through all of them.

  quality_rules    rejected documents go; failing lines of the others are removed and n_chars follows
  exact_dedup      of equal texts the longest original, then smallest doc_id stays
  near_dedup       one document of each near-duplicate component stays (smallest doc_id)
  mix_sources      documents are drawn to the sources' targets: left out, kept or repeated, always whole; a file
                   per shard, its rows in random order
  bpe              token ids, with digests of the ids and of the decoded text
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from topograph.llm.common import materialize, partitions, table

ID, TEXT, SOURCE, CHARS = "doc_id", "text", "source", "n_chars"


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all columns in one struct, so that no column of docs can clash with an operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in named], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def _unpacked(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """docs' columns from the struct, with a new text, and n_chars counted again where the text has changed."""
    old, new = F.col("__row").getField(TEXT), F.col(text)
    values = {TEXT: new, CHARS: F.when(old.eqNullSafe(new), F.col("__row").getField(CHARS)).otherwise(F.length(new))}
    kind = {f.name: f.dataType for f in docs.schema.fields}
    return rows.select(*[(values[c].cast(kind[c]) if c in values else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.quality(_packed(docs, ID, TEXT), carry=["__row"], with_text=True)
    return _unpacked(judged.filter("kept"), docs, "clean_text")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shards = partitions(spark)
    return _unpacked(mixing.in_shards(mixing.draw(_packed(docs, ID, TEXT, SOURCE), shards, whole=True), shards), docs, TEXT)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't encode tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
