"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle).  Its
signature has 12 chunks of 5 symbols, each the low 16 bits of a minimum hash.  By the pigeonhole principle two
signatures that differ in at most 2 * 12 - 1 = 23 symbols have a chunk that differs in at most one; each chunk is
therefore indexed under its five patterns with one symbol left out (the allowed errors), and signatures within
that distance always meet.  Texts at the similarity threshold of 0.75 differ in 15 of 60 symbols on average, and
they miss each other only if every chunk has two errors: with probability 6e-6 (1e-7 at 0.8, 1e-10 at 0.85).

Texts with equal word sequences (by SHA-256) are one class from the start (runs.py), so copies never multiply.  In each index
bucket all classes are first compared with its hub, the class that meets most others; texts that meet the threshold on
their full sets are linked, and connected components follow.  Buckets that still hold several components are
compared completely across components, in blocks of bounded size.  A pair is judged only in the first bucket that
it shares, and leaves its block only if it can still meet the threshold: by signature distance, by set sizes, and by
an exact bound on the intersection.  For sets x, y and the hub h, with x' the shingles of x that any other of
these texts holds,  |x & y| <= min(|x & h|, |y & h|) + min(|x' - h|, |y' - h|).

Null texts count as empty; texts without words have no set, link with nothing and are kept.  Repeated rows and
rows without an identifier are rows of their class: the representative is the smallest identifier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm import textnum
from topograph.llm.blocks import answer, answered, ask, cut, finish
from topograph.llm.common import materialize, materialize_bucketed, pack, partitions, unpack
from topograph.llm.graph import components
from topograph.llm.runs import equal_runs

SHINGLE, PERCENT = 5, 75
CHUNKS, SYMBOLS = 12, 5
LENGTH = CHUNKS * SYMBOLS
#: Pairs whose signatures differ in more symbols are not fetched: at similarity 0.75 one in a million does.
MAX_DISTANCE = 31
#: Most members of a block of a bucket, and pairs of one text that meet in one place.
BLOCK, PAIRS_PER_SALT = 512, 256
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
_MULTIPLIERS = textnum.mix(np.arange(1, LENGTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _short_hashes(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of whole sequences of fewer words than a shingle."""
    out = textnum.mix(counts.astype(np.uint64) ^ _SALT)
    for i in range(SHINGLE - 1):
        more = np.flatnonzero(counts > i)
        out[more] = textnum.join(out[more], values[first[more] + i], 1)
    return out


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each of n texts, sorted, and where each text's begin."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(doc[new], np.arange(n + 1))


def shingle_sets(words: textnum.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive texts, sorted within each text, and where each text's begin."""
    values, bounds, counts = words.hashes(), words.bounds, words.counts
    start, hashes = textnum.windows(values, bounds, SHINGLE)
    doc = np.searchsorted(bounds, start, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    return _distinct(np.concatenate([doc, short]), np.concatenate([hashes, _short_hashes(values, bounds[short], counts[short])]), len(counts))


def shingle_numbers(words: textnum.Words) -> tuple[np.ndarray, np.ndarray]:
    """Like shingle_sets(), with numbers that are equal exactly for equal shingles of these texts: words are compared, not hashes."""
    word, bounds, counts = words.ids(), words.bounds, words.counts
    start = textnum.window_starts(bounds, SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    columns = []
    for i in range(SHINGLE):  # a short text's sequence is filled up with a number that no word has
        at = np.minimum(bounds[short] + i, max(len(word) - 1, 0))
        columns.append(np.concatenate([word[start + i], np.where(counts[short] > i, word[at], -1)]))
    doc = np.concatenate([np.searchsorted(bounds, start, side="right") - 1, short])
    return _distinct(doc, textnum.row_ids(columns), len(counts))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of LENGTH 16-bit symbols per text with a set; bounds without empty sets."""
    out = np.zeros((len(bounds) - 1, LENGTH), np.uint16)
    if len(out):
        for i, a in enumerate(_MULTIPLIERS):
            least = np.minimum.reduceat(sets * a, bounds[:-1])
            out[:, i] = (textnum.mix(least ^ np.uint64(i)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of each signature: per chunk the patterns with one symbol left out; the low 6 bits hold the pattern's number."""
    chunks = signature.reshape(-1, CHUNKS, SYMBOLS).astype(np.uint64)
    out = np.empty((len(chunks), CHUNKS, SYMBOLS), np.uint64)
    for left_out in range(SYMBOLS):
        key = np.zeros(chunks.shape[:2], np.uint64)
        for s in range(SYMBOLS):
            if s != left_out:
                key = (key << np.uint64(16)) | chunks[:, :, s]
        slot = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(SYMBOLS) + np.uint64(left_out)
        out[:, :, left_out] = (textnum.mix(key ^ textnum.mix(slot + _SALT)) & ~np.uint64(63)) | slot
    return out.reshape(len(chunks), -1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, id, text -> uid, id, n_shingles, digest of the word sequence, signature (both null for empty sets)."""
    for batch in batches:
        for i, j, words in textnum.each_slice(batch.column(2), lower=True):
            sets, bounds = shingle_sets(words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            sigs = signatures(sets, np.append(bounds[:-1][full], len(sets)))
            same, sig_rows = [None] * (j - i), [None] * (j - i)
            raw, at = words.data.tobytes(), words.offsets.tolist()
            for k, sig in zip(full.tolist(), sigs):
                same[k], sig_rows[k] = hashlib.sha256(b" ".join(raw[at[k] : at[k + 1]].split())).digest(), sig.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sizes), pa.array(same, pa.binary()), pa.array(sig_rows, pa.binary())], names=["uid", "id", "n_shingles", "sequence", "signature"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, LENGTH)
            keys = index_keys(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "uid"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, their set sizes and signatures -> the pairs that can meet the threshold."""
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sigs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, LENGTH) for i in (4, 5)]
            ok = ((sigs[0] != sigs[1]).sum(axis=1) <= MAX_DISTANCE) & (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and both texts -> the pairs, how many shingles they share, and whether their full sets meet the threshold."""
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            n = batch.num_rows
            data, offsets = textnum.texts(pa.concat_arrays([batch.column(2), batch.column(3)]))
            numbers, bounds = shingle_numbers(textnum.Words(data, offsets, lower=True))
            sizes = np.diff(bounds)
            row = np.repeat(np.concatenate([np.arange(n), np.arange(n)]), sizes)
            order = np.lexsort((numbers, row))
            row, numbers = row[order], numbers[order]
            same = (row[1:] == row[:-1]) & (numbers[1:] == numbers[:-1])
            common = np.bincount(row[1:][same], minlength=n)
            ok = 100 * common >= PERCENT * (sizes[:n] + sizes[n:] - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common.astype(np.int64)), pa.array(ok)], names=["u", "v", "common", "linked"])


def _near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures and set sizes let them meet the threshold."""
    one = lambda side: sketches.select(F.col("uid").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_near, "a long, b long")


def _verify(near: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Distinct pairs (a, b) -> u, v, common, linked. texts is bucketed by uid and isn't shuffled by it; only these pairs fetch theirs."""
    near = materialize(near, f"{name}_near")
    # A hub's pairs are dealt out by salt, and its text once for each salt.
    salts = materialize(near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_SALT).cast("int").alias("salts")), f"{name}_salts")
    heads = texts.join(salts, F.col("uid") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("text_a"))
    tails = near.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")).join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
    both = tails.join(heads, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_linked, "u long, v long, common long, linked boolean"), f"{name}_links")


def _compare(rows: pa.Table) -> pa.RecordBatch | None:
    """Rows of a pair of blocks of one bucket -> its pairs across components that may meet the threshold."""
    slot = rows.column("key")[0].as_py() & 63
    side, uid, comp, n, shared, common, hub = (rows.column(c).to_numpy() for c in ("side", "uid", "component", "n_shingles", "with_hub", "common", "hub"))
    sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, LENGTH)
    # A text whose overlap with the hub was not counted is taken to share all it can.
    known = shared >= 0
    inside = np.where(known, shared, common)
    outside = np.where(known, common - shared, common)
    second = np.flatnonzero((side != 1) & (uid != hub))
    out_a, out_b = [], []
    for p in np.flatnonzero((side != 2) & (uid != hub)).tolist():  # at most BLOCK rounds over at most BLOCK rows
        q = second[comp[second] != comp[p]]
        if side[p] == 0:
            q = q[q > p]
        most = np.minimum(np.minimum(inside[q], inside[p]) + np.minimum(outside[q], outside[p]), np.minimum(common[q], common[p]))
        q = q[100 * most >= PERCENT * (n[q] + n[p] - most)]
        if len(q):
            differ = (sig[q] != sig[p]).reshape(-1, CHUNKS, SYMBOLS)
            errors = differ.sum(axis=2)
            chunk = np.argmax(errors <= 1, axis=1)
            first = chunk * SYMBOLS + np.argmax(differ[np.arange(len(q)), chunk], axis=1)
            q = q[(errors.sum(axis=1) <= MAX_DISTANCE) & (first == slot)]
            out_a.append(np.full(len(q), uid[p]))
            out_b.append(uid[q])
    if not sum(map(len, out_a)):
        return None
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j), the members of pairs of blocks -> candidate pairs."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if (group := tuple(ids[s].tolist())) != now:
                if held and (got := _compare(pa.Table.from_batches(held))) is not None:
                    yield got
                now, held = group, []
            held.append(batch.slice(s, e - s))
    if held and (got := _compare(pa.Table.from_batches(held))) is not None:
        yield got


def _common_shingles(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid, common: how many of a text's shingles occur in another of the wanted texts too."""
    blocks = cut(texts.join(wanted, "uid", "left_semi"), ["uid", "text"], "text", "near_open")
    buckets = blocks.buckets

    def sets_of(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, _, words in textnum.each_slice(block.column(1), lower=True):
            own, bounds = shingle_sets(words)
            sets.append(own)
            owner.append(i + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
        return np.concatenate(sets), np.concatenate(owner)

    def gather(block: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys, counts = np.unique(sets_of(block)[0], return_counts=True)
        return keys, textnum.mix(keys ^ _SALT), [counts]

    def resolve(keys: np.ndarray, of: np.ndarray, values: list[np.ndarray], blocks: np.ndarray):
        _, inverse = np.unique(keys, return_inverse=True)
        return [([np.bincount(inverse, weights=values[0].astype(np.float64))[inverse] > 1], None)], np.zeros(3, np.int64)

    def total(block: pa.Table, answers: pa.Table) -> pa.Table:
        sets, owner = sets_of(block)
        keys, inverse = np.unique(sets, return_inverse=True)
        (shared,) = answered(answers, keys, textnum.mix(keys ^ _SALT), buckets, 1)
        return pa.table({"uid": block.column(0), "common": pa.array(np.bincount(owner, weights=shared[inverse].astype(np.float64), minlength=block.num_rows).astype(np.int64))})

    return finish(blocks, materialize(answer(ask(blocks, gather), resolve, 1), "near_common"), total, "uid long, common long")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: identifier, carried columns, n_shingles, component_id, kept, is_representative.

    kept tells whether the row's identifier is its component's; is_representative marks exactly one row of each component
    (rows that repeat an identifier share kept).
    """
    spark = docs.sparkSession
    others = {c: f"__c{i}" for i, c in enumerate(carry or []) if c not in (id_column, text_column)}
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), *[F.col(f"`{c}`").alias(a) for c, a in others.items()])
    texts = materialize_bucketed(base, "near_texts", "uid", partitions(spark))
    id_type = base.schema["id"].dataType.simpleString()
    # Written, as the splitters of the runs are sampled from it before it is dealt out.
    sketch = materialize(texts.select("uid", "id", "text").mapInArrow(_sketch, f"uid long, id {id_type}, n_shingles long, sequence binary, signature binary"), "sketch")
    # Rows without a set are classes of their own: their key is their number.
    keyed = sketch.withColumn("__same", F.coalesce("sequence", F.concat(F.lit(b"-"), F.col("uid").cast("string").cast("binary")))).drop("sequence")
    rows = equal_runs(keyed, F.col("__same"), [F.col("uid")], "uid", "sequences", drop=["__same"]).select("uid", "id", "n_shingles", "signature", F.col("run_head").alias("class"), "is_head")
    rows = materialize(rows, "sketches")
    classes = rows.filter("is_head and signature is not null").select("uid", "n_shingles", "signature")

    keys = classes.select("uid", "signature").mapInArrow(_keys, "key long, uid long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    hits = materialize(keys.join(shared, "key").select("key", "uid", "members"), "hits")
    # The hub is the member that meets most others: in a family of edited copies their common original.
    popular = materialize(hits.groupBy("uid").agg(F.sum("members").alias("meets")), "popular")
    hubs = materialize(hits.join(popular, "uid").groupBy("key").agg(F.min(F.struct(-F.col("meets"), F.col("uid"))).getField("uid").alias("hub")), "hubs")
    buckets = materialize(hits.join(hubs, "key").select("key", "uid", "hub", "members"), "buckets")

    stars = buckets.filter("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct()
    met = _verify(_near_pairs(stars, classes), texts, "star")
    labels = components(met.filter("linked").select("u", "v"))

    label = F.coalesce("v", "uid")
    members = materialize(buckets.filter("members > 2").join(labels.withColumnRenamed("u", "uid"), "uid", "left").select("key", "uid", "hub", "members", label.alias("component")), "members")
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    members = materialize(members.join(mixed, "key", "left_semi"), "open_members")
    common = _common_shingles(texts, members.select("uid").distinct())
    facts = materialize(classes.join(common, "uid"), "facts")
    n = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("uid"), n).cast("int")
    spread = (
        members.join(facts, "uid").join(met.select(F.col("u").alias("hub"), F.col("v").alias("uid"), F.col("common").alias("with_hub")), ["hub", "uid"], "left")
        .withColumn("n", n).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
                "uid", "hub", "component", "n_shingles", "common", F.coalesce("with_hub", F.lit(-1)).cast("long").alias("with_hub"), "signature")
    )
    across = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_within_blocks, "a long, b long").distinct()
    more = _verify(across, texts, "across").filter("linked").select("u", "v")
    if not more.isEmpty():
        labels = components(labels.union(more))

    # One row per class: its component's smallest identifier and the row that stands for it.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))).alias("best")
    of_class = rows.groupBy("class").agg(best)
    placed = of_class.join(labels.select(F.col("u").alias("class"), "v"), "class", "left").select("class", "best", F.coalesce("v", "class").alias("component"))
    placed = materialize(placed, "placed")
    of_component = materialize(placed.groupBy("component").agg(F.min("best").alias("best")), "best")
    names = materialize(placed.select("class", "component").join(of_component, "component").select("class", F.col("best.id").alias("component_id"), F.col("best.uid").alias("stands")), "names")
    out = rows.select("uid", "id", "n_shingles", "class").join(names, "class")
    flags = [F.col("n_shingles"), F.col("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("uid") == F.col("stands")).alias("is_representative")]
    if carry is None:
        return out.select(F.col("id").alias(id_column), *flags)
    whole = texts.drop("id").join(out, "uid")
    named = {id_column: "id", text_column: "text"} | others
    return whole.select(F.col("id").alias(id_column), *[F.col(named[c]).alias(c) for c in carry if c != id_column], *flags)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stand for their component, with all their columns."""
    marked = near_dedup(pack(docs, id_column, text_column), "__p0", "__p1", carry=["__p1", "__rest"])
    return unpack(marked.filter("is_representative"), docs.columns, id_column, text_column)
