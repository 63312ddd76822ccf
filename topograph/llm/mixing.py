"""Mixing sources to target weights.

Targets: the sources, by code point and null last, weigh 1, 2, 3, repeating, and share the words of all
documents; a target stops at max_repeats times its source's words, and the excess is shared again by weight
until no target is above.

Blocks: a document's place in its source's random permutation is the first 60 bits of a seeded MD5 of its
identifier; equal intervals of places are blocks.  A source takes as many whole passes as fit its target, and in
one further pass the places up to a bound, found exactly by descending through block totals (a radix select
over blocks, then over blocks inside the block that holds the bound).  The document at the bound is taken in
part, so a source's words meet its target to the word; rows that share that place (repeated identifiers,
nulls) share the rest in proportion to their sizes.

Shards: the numbers of block draws per source are split over the output shards by a tree: at each node a
multivariate hypergeometric draw gives the left half its blocks of every source.  A shard takes a run of the
source's permuted block draws, disjoint from the other shards', and shuffles its rows locally.

Null texts have size 0 and are never taken; an empty table gives an empty mix.  Rows are never split by source in
one task: all sums are pre-aggregated per block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topograph.llm.common import WORD, materialize

#: Bits of a place that one descent step resolves, and all bits of a place.
STEP_BITS, PLACE_BITS = 12, 60
#: Most rows of the table of dealt blocks that are sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_column: str, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """sizes: a row per source (source, source_size). Adds weight, target.

    Resharing the excess by weight until none is above is the same as finding the level t with
    sum(min(max_repeats * size, t * weight)) = total; the sources that stop are those of the smallest
    size per weight, so running sums over that order give the level.
    """
    cap, total = F.col("__cap"), F.col("__total")
    # One row per source: a table of the size of the list of sources, not of the documents.
    named = sizes.withColumn("weight", (F.pmod(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("double"))
    every = Window.partitionBy(F.lit(0))
    by_level = every.orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        named.withColumn("__cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("__total", F.sum("source_size").over(every).cast("double"))
        .withColumn("__level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("__stops", cap < F.col("__level") * F.col("weight"))
        .withColumn("__common", F.max(F.when(~F.col("__stops"), F.col("__level"))).over(every))
    )
    return levels.select("source", "source_size", "weight", F.when(F.col("__stops"), cap).otherwise(F.least(cap, F.col("__common") * F.col("weight"))).alias("target"))


def _bounds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: the place at which the last pass ends, the words left for it and the words at it (null where it takes nothing)."""
    found = plan.select(F.col("source").alias("__s"), F.lit(0).cast("long").alias("lo"), F.col("rest").alias("left"))
    for shift in range(PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        width = 1 << (shift + STEP_BITS)
        inside = rows.join(found, F.col("source").eqNullSafe(F.col("__s")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + width))
        cells = inside.groupBy("__s", "lo", "left", F.shiftright("place", shift).alias("cell")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("__s").orderBy("cell"))
        found = cells.withColumn("upto", run).filter("upto > left and upto - words <= left").select("__s", F.expr(f"shiftleft(cell, {shift})").alias("lo"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), F.col("words").alias("at_words"))
        found = materialize(found, "bounds")
        if shift:
            found = found.drop("at_words")
    return found


def _planned(docs: DataFrame, id_column: str, text_column: str, source_column: str, max_repeats: int, seed: int, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with the columns to carry; the same rows without, materialized; per source (__s) its target, whole passes and bound."""
    others = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry or [])]
    every = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{source_column}`").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"), *others).withColumn("place", place("__id", seed))
    slim = materialize(every.select("__id", "source", "size", "place"), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, max_repeats).withColumn("words", F.bround("target").cast("long"))
    plan = plan.withColumn("full", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
    plan = materialize(plan, "plan")
    bounds = _bounds(slim, plan).withColumnRenamed("lo", "bound")
    known = materialize(plan.join(bounds, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumnRenamed("source", "__s"), "known")
    return every, slim, F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def _taken(rows: DataFrame, known: DataFrame, whole: bool = False) -> DataFrame:
    """rows with source_size, target, passes (whole copies), part (words of a further copy) and taken (words).

    whole: what lies at the bound is taken whole or left out, whichever is nearer to the target.
    """
    at_bound = F.expr("if(2 * left >= at_words, size, 0)" if whole else "size * left div at_words")
    part = F.when(F.col("place") < F.col("bound"), F.col("size")).when(F.col("place") == F.col("bound"), at_bound).otherwise(F.lit(0)).cast("long")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("__s")), "left")
    return joined.select(*rows.columns, "source_size", "target", (F.col("full") * F.col("size") + part).alias("taken"), F.col("full").alias("passes"), part.alias("part"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: size, source_size, target, taken (words), passes (whole copies), part (words of a further copy), place."""
    _, slim, known = _planned(docs, id_column, text_column, source_column, max_repeats, seed)
    return _taken(slim, known).select(F.col("__id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "taken", "passes", "part", "place")


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = 7) -> np.ndarray:
    """quotas: block draws per source. Returns a row per shard: how many draws of each source it takes; columns sum to the quotas.

    Each node draws its left half from all its blocks without replacement.
    """
    quotas = np.asarray(quotas, np.int64)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(at: int, n: int, own: np.ndarray, rng: np.random.Generator) -> None:
        if n == 1:
            out[at] = own
            return
        half = n // 2
        total = int(own.sum())
        left = rng.multivariate_hypergeometric(own, total * half // n, method="marginals") if total else own * 0
        split(at, half, left, np.random.default_rng([seed, at, half]))
        split(at + half, n - half, own - left, np.random.default_rng([seed, at + half, n - half]))

    split(0, shards, quotas, np.random.default_rng([seed, 0, shards]))
    return out


def _copies(taken: DataFrame, block_bits: int) -> DataFrame:
    """A row for each copy taken, with pass_no and __block."""
    copies = taken.filter("taken > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int")))).filter("pass_no < passes or part > 0")
    return copies.withColumn("__block", F.shiftright("place", PLACE_BITS - block_bits).cast("int"))


def draw(docs: DataFrame, shards: int = 8, block_bits: int = 6, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", max_repeats: int = 3, seed: int = 7, whole: bool = False) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy taken, with shard, pass_no and shuffle_key, the random order of a shard's rows.

    The one copy taken in part keeps its first words, joined by one space; with whole it is kept whole or left out,
    whichever is nearer to the target.  A source has 2**block_bits blocks a pass, or
    more where there are many shards, so that each shard gets several.
    """
    return _drawn(docs, shards, block_bits, id_column, text_column, source_column, max_repeats, seed, whole)[0]


def _drawn(docs: DataFrame, shards: int, block_bits: int, id_column: str, text_column: str, source_column: str, max_repeats: int, seed: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The result of draw(), and that of mix()."""
    spark, block_bits = docs.sparkSession, max(block_bits, (4 * shards - 1).bit_length())
    # All columns of docs travel in one struct, so that none can clash with the operator's own.
    packed = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text_column}`").alias("__text"), F.col(f"`{source_column}`").alias("__source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    every, slim, plan = _planned(packed, "__id", "__text", "__source", max_repeats, seed, carry=["__text", "__row"])
    # A row per source, pass and block, at most (max_repeats + 1) * 2**block_bits for each source: what the tree deals out.
    drawn = materialize(_copies(_taken(slim, plan, whole), block_bits).groupBy(F.col("source").alias("__source"), "pass_no", "__block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    known = drawn.groupBy("__source").agg(F.count(F.lit(1)).alias("quota")).orderBy(F.col("__source").asc_nulls_last()).collect()
    table = np.cumsum(splitting_tree(np.array([r["quota"] for r in known], np.int64), shards, seed), axis=0)
    ends = spark.createDataFrame([(r["__source"], [int(x) for x in table[:, i]]) for i, r in enumerate(known)], "__s string, ends array<long>")
    order = Window.partitionBy("__source").orderBy("pass_no", F.md5(F.concat_ws("|", F.lit(seed), "pass_no", "__block")))
    dealt = drawn.withColumn("at", F.row_number().over(order) - 1).join(ends, F.col("__source").eqNullSafe(F.col("__s")))
    dealt = dealt.select(F.col("__source").alias("__s"), F.col("pass_no").alias("__p"), F.col("__block").alias("__b"), F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"))
    copies = _copies(_taken(every, plan, whole), block_bits).withColumnsRenamed({"__c0": "__text", "__c1": "__row"})
    text = F.col("__text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when((F.col("pass_no") == F.col("passes")) & (F.col("part") < F.col("size")), F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")).otherwise(text)
    few = len(known) * (max_repeats + 1) << block_bits <= BROADCAST_ROWS
    joined = copies.join(F.broadcast(dealt) if few else dealt, (F.col("__b") == F.col("__block")) & (F.col("__p") == F.col("pass_no")) & F.col("__s").eqNullSafe(F.col("source")))
    out = joined.select(*[cut.alias(c) if c == text_column else F.col("__row").getField(c).alias(c) for c in docs.columns], "shard", "pass_no", F.md5(F.concat_ws("|", F.lit(seed), "pass_no", "place")).alias("shuffle_key"))
    return out, _taken(slim, plan, whole)


def in_shards(drawn: DataFrame, shards: int) -> DataFrame:
    """drawn: the result of draw(). A partition per shard, its rows in random order; without shuffle_key."""
    kept = [c for c in drawn.columns if c != "shuffle_key"]
    return drawn.repartitionById(shards, "shard").sortWithinPartitions("shard", "shuffle_key").select(*kept)


def write_shards(drawn: DataFrame, path: str, shards: int) -> None:
    """drawn: the result of draw(). A folder per shard, its rows in random order."""
    in_shards(drawn, shards).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def write_mix(docs: DataFrame, path: str, shards: int, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """Draws the mix and writes its shards; a row per document as from mix(), whose taken is counted in the copies written.

    Rows of one identifier, source and size are taken alike, so they share the words of their copies evenly.
    """
    key = ["__i", "__o", "__n"]
    plain = docs.select(F.col(f"`{id_column}`").alias("__i"), F.col(f"`{source_column}`").alias("__o"), F.col(f"`{text_column}`").alias("__t")).withColumn("__n", word_count(F.col("__t")))
    drawn, every = _drawn(plain, shards, 6, "__i", "__t", "__o", max_repeats, seed)
    write_shards(drawn, path, shards)
    written = docs.sparkSession.read.schema(drawn.drop("shuffle_key").schema).parquet(path)
    counted = written.groupBy(*key).agg(F.sum(word_count(F.col("__t"))).alias("all_words"))
    alike = every.groupBy(F.col("__id").alias("__i"), F.col("source").alias("__o"), F.col("size").alias("__n")).agg(F.count(F.lit(1)).alias("rows"))
    same = lambda a, b: a["__i"].eqNullSafe(b["__i"]) & a["__o"].eqNullSafe(b["__o"]) & (a["__n"] == b["__n"])
    each = alike.join(counted, same(alike, counted), "left").select(alike["__i"], alike["__o"], alike["__n"], F.expr("coalesce(all_words, 0) div rows").cast("long").alias("words"))
    rows = every.drop("taken", "passes", "part")
    joined = rows.join(each, rows["__id"].eqNullSafe(each["__i"]) & rows["source"].eqNullSafe(each["__o"]) & (rows["size"] == each["__n"]), "left")
    return joined.select(F.col("__id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "place")
