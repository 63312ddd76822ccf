"""Ranks without a single sorting task, and ranking metrics with ordinal ranks: ties are broken by the row's key, never averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topograph.functions.lineage import cut_lineage


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 0) in an order that leaves no ties: ranges are sorted in parallel and numbered by their counts."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(ranged)  # ranges are sampled: what follows must see the same ones
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    start = counts.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row per range
    joined = placed.withColumn("__part", part).join(F.broadcast(start), "__part")
    return joined.withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")).drop("__part", "__start", "__at")


def ranked_within(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place (from 0) in each group; a group may fill any number of ranges."""
    if not group:
        return ranked(rows, order, name)
    every = ranked(rows, [*[F.col(g) for g in group], *order], "__of_all")  # read twice, from the table that ranked() has written
    first = every.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.min("__of_all").alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return every.join(first, same).select(*rows.columns, (F.col("__of_all") - F.col("__first")).alias(name))


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order without ties; unlike a sorted limit, no task gathers them."""
    return ranked(rows, order, "__place").filter(F.col("__place") < n).drop("__place")


def auroc(rows: DataFrame, group: list[str], score: str, label: str, key: str) -> DataFrame:
    """group, auroc: from the rank sum of the positives; 0.5 when a class is missing."""
    hit = F.col("__hit")
    slim = rows.select(*group, F.col(score).alias("__score"), F.col(key).alias("__key"), (F.col(label) == 1).cast("long").alias("__hit"))
    placed = ranked_within(slim, group, [F.col("__score").asc(), F.col("__key").asc()], "__rank")
    sums = placed.groupBy(*group).agg(F.sum(hit).cast("double").alias("p"), F.sum(1 - hit).cast("double").alias("n"), F.sum(hit * (F.col("__rank") + 1)).cast("double").alias("r"))
    value = F.when((F.col("p") == 0) | (F.col("n") == 0), 0.5).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n")))
    return sums.select(*group, value.alias("auroc"))


def average_precision(rows: DataFrame, group: list[str], score: str, label: str, key: str) -> DataFrame:
    """group, average_precision: mean precision at the positives in falling order of score; 0 without positives.

    The positives up to one of them are its place among the positives, so two rankings replace a running sum.
    """
    order = [F.col("__score").desc(), F.col("__key").asc()]
    slim = rows.select(*group, F.col(score).alias("__score"), F.col(key).alias("__key"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("__hit"))
    hits = ranked_within(slim, group, order, "__rank").filter("__hit")
    seen = ranked_within(hits, group, order, "__seen")
    means = seen.groupBy(*group).agg(F.avg((F.col("__seen") + 1) / (F.col("__rank") + 1)).alias("average_precision"))
    if not group:
        return means.select(F.coalesce("average_precision", F.lit(0.0)).alias("average_precision"))
    named = means.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "average_precision")
    every = rows.select(*group).distinct().join(named, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)], "left")
    return every.select(*group, F.coalesce("average_precision", F.lit(0.0)).alias("average_precision"))


def univariate_signal(rows: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """Per feature: class means, their difference, AUROC and rank-biserial correlation, strongest first."""
    long = rows.select(key, label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value")) for f in features])).alias("f")).select(key, label, "f.feature", "f.value")
    mean = lambda c: F.avg(F.when(F.col(label) == c, F.col("value")))
    means = long.groupBy("feature").agg(mean(1).alias("positive_mean"), mean(0).alias("negative_mean"))
    both = means.join(auroc(long, ["feature"], "value", label, key), "feature")
    return both.select("feature", "positive_mean", "negative_mean", (F.col("positive_mean") - F.col("negative_mean")).alias("mean_difference"), "auroc", (2 * F.col("auroc") - 1).alias("rank_biserial")).orderBy(F.col("auroc").desc(), "feature")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(0.0)


def cosine(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """group, cosine of the long columns a and b; 0 when a norm is 0."""
    norm = F.sqrt(F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))
    return rows.groupBy(*group).agg(ratio(F.sum(F.col(a) * F.col(b)), norm).alias("cosine"))


def with_row_index(rows: DataFrame, key: str) -> DataFrame:
    """row_idx: place in the order of a unique key."""
    return ranked(rows, [F.col(key)], "row_idx")


#: Vectors of a block of pairs, and rows of it that are multiplied at once.
BLOCK, STRIP = 16_384, 128


def _matrix(rows: pa.Array) -> np.ndarray:
    """Vectors as rows; missing ones are zeros."""
    there = np.array(rows.is_valid())
    cells = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), len(cells) // max(int(there.sum()), 1)))
    out[there] = cells.reshape(int(there.sum()), -1) if there.any() else 0
    return out


def cosines(vectors: DataFrame, group: str) -> DataFrame:
    """group, id, other, cosine of all pairs id < other within each group; 0 beside a vector of zeros. vectors: group, id long, v array<double>.

    Vectors are dealt into blocks, as many as a group's own size asks for; each two blocks of a group meet in a row of their own, whose products are made strip by
    strip. A vector is sent once for each block of its group.
    """
    sizes = cut_lineage(vectors.groupBy(group).agg(F.floor(F.count(F.lit(1)) / BLOCK).alias("__blocks")))
    packed = vectors.join(sizes, group).groupBy(group, F.pmod(F.xxhash64("id"), F.col("__blocks") + 1).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("own"))
    packed = cut_lineage(packed.select(group, "block", F.col("own").getField("id").alias("ids"), F.col("own").getField("v").alias("vs")))
    other = packed.withColumnsRenamed({"block": "to", "ids": "others", "vs": "os"})
    met = packed.join(other, group).filter(F.col("block") <= F.col("to"))
    kind = dict(vectors.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                key, block, ids, vs, to, others, os = (batch.column(c)[row] for c in (group, "block", "ids", "vs", "to", "others", "os"))
                left, right = (i.values.to_numpy() for i in (ids, others))
                x, y = _matrix(vs.values), _matrix(os.values)
                x, y = (m if m.any() else np.zeros((len(m), max(x.shape[1], y.shape[1]))) for m in (x, y))
                nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
                for at in range(0, len(left), STRIP):
                    size = np.sqrt(nx[at : at + STRIP, None] * ny[None, :])
                    value = np.divide(x[at : at + STRIP] @ y.T, size, out=np.zeros_like(size), where=size > 0)
                    first, second = np.broadcast_arrays(left[at : at + STRIP, None], right[None, :])
                    kept = first != second if block.as_py() != to.as_py() else first < second
                    a, b = first[kept], second[kept]
                    columns = [pa.array([key.as_py()] * len(a), batch.schema.field(group).type), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value[kept])]
                    for part in range(0, len(a), 100_000):
                        yield pa.RecordBatch.from_arrays([c.slice(part, 100_000) for c in columns], names=[group, "id", "other", "cosine"])

    return met.repartition(F.col(group), F.col("block"), F.col("to")).mapInArrow(run, f"{group} {kind}, id long, other long, cosine double")
