"""Substring dedup by relative Lempel-Ziv parsing against all blocks.

Every block of documents is a reference block, indexed by all its windows of k words (blocks.py); the index answers
each window with the block and place where it starts first in the corpus.  A document is factored greedily: a factor
begins at a window that also starts earlier, and is extended along that reference for as long as the next window
starts earlier at the reference's next place, so a factor is one phrase of one reference block.  Windows across a
factor's boundaries are looked up like any others, so the union of all factors is the set of duplicate spans.
Earlier means a smaller identifier, or the same document and an earlier start.

The index knows windows by two independent hashes.  What it answers is checked on the words: the reference
block compares each factor's words with its own (by 128 bits of SHA-256 over the words in order), and only confirmed factors are
removed.  A factor that fails is asked about window by window; a window that differs from the one found stays.

Null texts count as empty; texts shorter than a window lose nothing; null identifiers come last, negative ones
first; rows that repeat an identifier are ordered by block and place.  Identifiers are integers.  Windows are judged
on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topograph.llm import textnum
from topograph.llm.blocks import Blocks, answer, answered, ask, cut, finish
from topograph.llm.common import materialize

LAST, _SIGN = (1 << 63) - 1, np.uint64(1 << 63)
SCHEMA = "{id} {kind}, n_words long, n_removed long, kept_sha256 string"
#: A factor: its place in its block (counted in words), its length, its reference's place, and the digest of its words.
FACTORS = "block long, start long, n long, ref_block long, ref_start long, words binary"
_REFERENCE = ["ref_block", "ref_start", "n", "words"]


class _Rows:
    """A block's documents in order of identifier and place."""

    def __init__(self, block: pa.Table):
        ids = pc.fill_null(block.column(0), LAST).to_numpy().astype(np.int64)
        order = np.lexsort((block.column("place").to_numpy(), ids))
        self.block = block.column("block")[0].as_py()
        self.rows, self.ids = block.take(pa.array(order)), ids[order]

    def words(self, i: int) -> list[bytes]:
        text = self.rows.column(1)[i]
        return text.as_buffer().to_pybytes().split() if text.is_valid else []


class _Windows(_Rows):
    """The windows of a block, in order, by hash; bits: of the hash, fewer only to test that nothing rests on it."""

    def __init__(self, block: pa.Table, k: int, bits: int = 64):
        super().__init__(block)
        counts, first, second, where, owner, at = [], [], [], [], [], 0
        for i, _, words in textnum.each_slice(self.rows.column(1)):
            start, h = textnum.windows(words.hashes(0), words.bounds, k)
            counts.append(words.counts)
            first.append(h)
            second.append(textnum.windows(words.hashes(2), words.bounds, k, 2)[1])
            where.append(start + at)
            owner.append(i + np.searchsorted(words.bounds, start, side="right") - 1)
            at += len(words.start)
        empty = [np.zeros(0, np.int64)]
        self.counts, self.where, self.owner = (np.concatenate(x or empty) for x in (counts, where, owner))
        hashes, second = (np.concatenate(x or [np.zeros(0, np.uint64)]) for x in (first, second))
        if bits < 64:
            hashes = second = hashes & np.uint64((1 << bits) - 1)
        self.keys, self.first, self.inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.second = second[self.first]

    def asked(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each distinct window with the document and the place of its first start here; identifiers keep their order as unsigned."""
        ids = self.ids[self.owner[self.first]].astype(np.uint64) ^ _SIGN
        return self.keys, self.second, [ids, self.where[self.first]]


def _resolve(keys: np.ndarray, of: np.ndarray, values: list[np.ndarray], blocks: np.ndarray) -> tuple[list[tuple[list[np.ndarray], None]], np.ndarray]:
    """Of all blocks that hold a window, the one with the smallest document (then block) owns it. The others are answered its number, plus one, and the place."""
    block, place = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    order = np.argsort(keys, kind="stable")
    shared = keys[order[1:]] == keys[order[:-1]]
    if shared.any():
        member = np.zeros(len(keys), bool)
        member[1:] |= shared
        member[:-1] |= shared
        some = order[member]
        some = some[np.lexsort((blocks[of[some]], values[0][some], keys[some]))]
        new = np.ones(len(some), bool)
        new[1:] = keys[some[1:]] != keys[some[:-1]]
        head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        later = some[~new]
        block[later], place[later] = (blocks[of[head[~new]]] + 1).astype(np.uint64), values[1][head[~new]]
    return [([block, place], None)], np.zeros(3, np.int64)


def factors(ref_block: np.ndarray, ref_start: np.ndarray, start: np.ndarray, owner: np.ndarray, k: int) -> list[tuple[int, int, int, int, int]]:
    """(document, first word, end, reference block, place there) of the greedy factors.

    ref_block and ref_start: for each window, in order, where it starts earlier (block -1: nowhere).
    """
    at = np.flatnonzero(ref_block >= 0)
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    a, b = at[1:], at[:-1]
    new[1:] = (owner[a] != owner[b]) | (start[a] != start[b] + 1) | (ref_block[a] != ref_block[b]) | (ref_start[a] != ref_start[b] + 1)
    first = np.flatnonzero(new)
    last = at[np.append(first[1:], len(at)) - 1]
    head = at[first]
    return list(zip(owner[head].tolist(), start[head].tolist(), (start[last] + k).tolist(), ref_block[head].tolist(), ref_start[head].tolist()))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _parse(blocks: Blocks, answers: DataFrame, k: int, bits: int) -> DataFrame:
    buckets = blocks.buckets

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Windows(block, k, bits)
        owner, place = (x.astype(np.int64) for x in answered(answers, own.keys, own.second, buckets, 2))
        ref_block, ref_start = owner[own.inverse] - 1, place[own.inverse]
        # A window that this block owns starts earlier at its first place here.
        mine = np.ones(len(own.inverse), bool)
        mine[own.first] = False
        mine &= ref_block < 0
        ref_block[mine], ref_start[mine] = own.block, own.where[own.first][own.inverse[mine]]
        bounds, rows, now, words = np.concatenate([[0], np.cumsum(own.counts)]).tolist(), [], -1, []
        for doc, a, b, where, at in factors(ref_block, ref_start, own.where, own.owner, k):
            if doc != now:
                now, words = doc, own.words(doc)
            rows.append((own.block, a, b - a, where, at, _digest(words[a - bounds[doc] : b - bounds[doc]])))
        return _table(rows)

    return finish(blocks, answers, run, FACTORS)


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64()] * 5 + [pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=["block", "start", "n", "ref_block", "ref_start", "words"])


def _refuted(blocks: Blocks, found: DataFrame) -> DataFrame:
    """The references (_REFERENCE) whose words are not those of the factor; each is checked once, where its text is."""
    asks = found.groupBy(*_REFERENCE).agg(F.first("ref_block").alias("block"))

    def run(block: pa.Table, asks: pa.Table) -> pa.Table:
        bad = []
        if asks.num_rows and block.num_rows:
            own, columns = _Rows(block), [asks.column(c).to_pylist() for c in _REFERENCE]
            order = sorted(range(asks.num_rows), key=columns[1].__getitem__)
            doc, begin, words = -1, 0, []
            for i in order:
                at, n = columns[1][i], columns[2][i]
                while at >= begin + len(words):
                    begin, doc = begin + len(words), doc + 1
                    words = own.words(doc)
                if _digest(words[at - begin : at - begin + n]) != columns[3][i]:
                    bad.append(i)
        return asks.select(_REFERENCE).take(pa.array(bad, pa.int64()))

    return blocks.rows.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(run, "ref_block long, ref_start long, n long, words binary")


def _confirmed(blocks: Blocks, found: DataFrame, k: int) -> DataFrame:
    """The factors whose words are their reference's; of one that isn't, its windows that are."""
    refuted = materialize(_refuted(blocks, found), "refuted")
    if refuted.isEmpty():
        return found
    good = found.join(refuted, _REFERENCE, "left_anti").select(*found.columns)
    single = found.join(refuted, _REFERENCE, "left_semi").select("block", "ref_block", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("n") - k)).alias("i", "start"), "ref_start")
    single = single.select("block", "start", F.lit(k).cast("long").alias("n"), "ref_block", (F.col("ref_start") + F.col("i")).alias("ref_start"))

    def words_of(block: pa.Table, asks: pa.Table) -> pa.Table:
        rows = []
        if asks.num_rows and block.num_rows:
            own, doc, begin, words = _Rows(block), -1, 0, []
            for at, n, where, there in sorted(zip(*[asks.column(c).to_pylist() for c in ("start", "n", "ref_block", "ref_start")])):
                while at >= begin + len(words):
                    begin, doc = begin + len(words), doc + 1
                    words = own.words(doc)
                rows.append((own.block, at, n, where, there, _digest(words[at - begin : at - begin + n])))
        return _table(rows)

    windows = materialize(blocks.rows.groupBy("block").cogroup(single.groupBy("block")).applyInArrow(words_of, FACTORS), "single_windows")
    return good.union(windows.join(materialize(_refuted(blocks, windows), "refuted"), _REFERENCE, "left_anti").select(*found.columns))


def substring_dedup(docs: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, bits: int = 64) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256; with_text adds kept_text and removed_spans (word ranges of the factors)."""
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise TypeError(f"{id_column} must be an integer column: identifiers say which document is earlier")
    blocks = cut(docs, [id_column, text_column], text_column, "windows")
    answers = materialize(answer(ask(blocks, lambda block: _Windows(block, k, bits).asked()), _resolve, 2), "owners")
    spans = _confirmed(blocks, materialize(_parse(blocks, answers, k, bits), "factors"), k).select("block", "start", "n")

    def remove(block: pa.Table, spans: pa.Table) -> pa.Table:
        own, counts, removed, texts, shas, ranges, begin, at = _Rows(block), [], [], [], [], [], 0, 0
        found = sorted(zip(spans.column("start").to_pylist(), spans.column("n").to_pylist()))
        for i in range(own.rows.num_rows):
            words, mine = own.words(i), []
            kept = np.ones(len(words), bool)
            while at < len(found) and found[at][0] < begin + len(words):
                a, n = found[at][0] - begin, found[at][1]
                kept[a : a + n] = False
                mine.append({"start": a, "end": a + n})
                at += 1
            begin += len(words)
            counts.append(len(words))
            removed.append(int(len(words) - kept.sum()))
            text = b" ".join(compress(words, kept.tolist()) if mine else words)
            shas.append(hashlib.sha256(text).hexdigest())
            if with_text:
                texts.append(text.decode("utf-8"))
                ranges.append(mine)
        out = [own.rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
        names = [id_column, "n_words", "n_removed", "kept_sha256"]
        if with_text:
            out += [pa.array(texts, pa.string()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names += ["kept_text", "removed_spans"]
        return pa.table(out, names=names)

    schema = SCHEMA.format(id=f"`{id_column}`", kind=docs.schema[id_column].dataType.simpleString())
    return blocks.rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, schema + ", kept_text string, removed_spans array<struct<start: bigint, end: bigint>>" * with_text)
