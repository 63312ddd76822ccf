"""Exact dedup by content sort.

Texts are equal when identical after deleting white space; null counts as empty, so null, empty and blank
texts form one group.  Sampled splitters range-partition the normalised bytes, an external sort places
equal texts next to each other, and full comparisons of neighbours find the groups (runs.py).  Of a group
the row with the most code points in its original text stays, then the smallest identifier (null last).
Exactly one row of a group stays, even where rows are repeated whole or identifiers are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm.common import pack, unpack, without_space
from topograph.llm.runs import equal_runs


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None, heads_only: bool = False) -> DataFrame:
    """One row per row of docs: the identifier, the carried columns, keep_id, group_size, kept, text_sha256.

    heads_only leaves out rows that aren't kept, but for at most one of a group in each range of the sort.
    """
    carry = [c for c in carry or [] if c != id_column]
    text, order = F.col(f"`{text_column}`"), [F.col("__length").desc(), F.col("__id").asc_nulls_last()]
    mine = [F.col(f"`{id_column}`").alias("__id"), F.coalesce(F.length(text), F.lit(0)).alias("__length")]
    mine += [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry) if c != text_column]
    if carry:  # whole texts travel, and the key is made where they arrive
        rows, key = docs.select(*mine, text.alias("__text")), without_space(F.coalesce(F.col("__text"), F.lit("")))
    else:
        rows, key = docs.select(*mine, without_space(F.coalesce(text, F.lit(""))).alias("__text")), F.col("__text")
    runs = equal_runs(rows, key, order, "__id", "exact", drop=[] if text_column in carry else ["__text"], heads_only=heads_only)
    return runs.select(
        F.col("__id").alias(id_column),
        *[F.col("__text" if c == text_column else f"__c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("run_head").alias("keep_id"),
        F.col("run_size").alias("group_size"),
        F.col("is_head").alias("kept"),
        F.col("key_sha256").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    marked = exact_dedup(pack(docs, id_column, text_column), "__p0", "__p1", carry=["__p1", "__rest"], heads_only=True)
    return unpack(marked.filter("kept"), docs.columns, id_column, text_column)
