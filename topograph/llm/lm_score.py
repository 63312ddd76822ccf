"""Language-model scoring by deleted interpolation.

P(w | u) = l2 c(u,w)/c(u) + l1 c(w)/N + l0 /(V+1), with weights (l2, l1, l0) for each bucket of the context's
frequency (its binary logarithm).  The weights are learned by expectation-maximisation on held-out counts: a tenth
of the training documents is deleted from the counts, the rest predicts it, and the weights maximise its
likelihood.  The final counts come from all training documents.

Tokens are words with A-Z lower-cased, then one end token per document; the context of the first token is the
start of the document.  A document is held out of training when crc32(identifier as text) mod 10 is 0 (a
null identifier counts as empty text, whose crc32 is 0).  Null texts count as empty and score their end token.

All n-gram counts of the corpus are gathered by an index over packed keys (blocks.py): each block asks about
its distinct words and word pairs with its own counts and learns the totals.  EM reads a distributed table of
distinct (bucket, pair count, context count, word count) with multiplicities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topograph.llm import textnum
from topograph.llm.blocks import answer, answered, ask, cut, finish
from topograph.llm.common import materialize

#: Hashes of the end token and of the start of a document; keys of words and pairs differ by these salts.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_WORD, _PAIR = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0676A9A99)
BUCKETS, FOLDS, DELETED, ROUNDS = 24, 10, 1, 12
SCHEMA = "{id} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(identifier: object) -> int:
    return zlib.crc32(b"" if identifier is None else str(identifier).encode()) % FOLDS


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


class _Block:
    """Tokens of a block: keys of their words, contexts and pairs."""

    def __init__(self, block: pa.Table):
        self.ids = block.column(0)
        self.folds = np.array([fold(i.as_py()) for i in self.ids], np.int64)
        word, other, counts = [], [], []
        for _, _, words in textnum.each_slice(block.column(1), lower=True):
            ends = words.bounds[1:]
            word.append(np.insert(words.hashes(0), ends, END))
            other.append(np.insert(words.hashes(2), ends, END))
            counts.append(words.counts + 1)
        zero = np.zeros(0, np.uint64)
        word, other = np.concatenate(word or [zero]), np.concatenate(other or [zero])
        self.counts = np.concatenate(counts or [np.zeros(0, np.int64)])
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

        def before(h: np.ndarray) -> np.ndarray:
            out = np.empty_like(h)
            out[1:] = h[:-1]
            out[self.bounds[:-1]] = START
            return out

        keys = np.concatenate([textnum.mix(word ^ _WORD), textnum.mix(word * _PAIR + textnum.mix(before(word)))])
        # The start of a document is asked about too: its count as a context is the number of documents.
        self.start_key = textnum.mix(np.array([START ^ _WORD], np.uint64))
        seconds = np.concatenate([textnum.mix(other ^ _PAIR), textnum.mix(other * _WORD + textnum.mix(before(other)))])
        # The lowest bit of a key tells words from pairs.
        keys = np.concatenate([keys & ~np.uint64(1), self.start_key & ~np.uint64(1)])
        keys[: len(word)] |= np.uint64(1)
        self.keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.second = np.concatenate([seconds, self.start_key])[first]
        n = len(word)
        self.word, self.pair, self.start = inverse[:n], inverse[n : 2 * n], int(inverse[2 * n])
        context = np.empty(n, np.int64)
        context[1:] = self.word[:-1]
        context[self.bounds[:-1]] = self.start
        self.context = context

    def tally(self, docs: np.ndarray) -> np.ndarray:
        """How often each key occurs in the marked documents."""
        mine = docs[self.doc]
        out = np.bincount(self.word[mine], minlength=len(self.keys)) + np.bincount(self.pair[mine], minlength=len(self.keys))
        out[self.start] = int(docs.sum())
        return out


def _gather(block: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    own = _Block(block)
    train, deleted = own.folds != 0, own.folds == DELETED
    return own.keys, own.second, [own.tally(train), own.tally(deleted)]


def _resolve(keys: np.ndarray, of: np.ndarray, values: list[np.ndarray], blocks: np.ndarray) -> tuple[list[tuple[list[np.ndarray], np.ndarray | None]], np.ndarray]:
    """Every key's training count; for keys of a block's deleted documents also the count without all deleted ones."""
    known, inverse = np.unique(keys, return_inverse=True)
    train, deleted = (np.bincount(inverse, weights=v.astype(np.float64)).astype(np.int64) for v in values)
    word = (known & np.uint64(1)) == 1
    totals = np.array([train[word].sum(), (train[word] > 0).sum(), deleted[word].sum()])
    return [([train[inverse]], None), ([(train - deleted)[inverse]], values[1] > 0)], totals


def fit_weights(events: DataFrame, totals: tuple[int, int], rounds: int = ROUNDS) -> list[list[float]]:
    """events: bucket, pair, context, word, n (counts without the deleted documents, and how often). A row (l2, l1, l0) per bucket."""
    n_tokens, n_types = totals
    weights = [[1 / 3, 1 / 3, 1 / 3] if b else [0.0, 0.5, 0.5] for b in range(BUCKETS)]
    for _ in range(rounds):
        of = [F.element_at(F.array(*[F.lit(float(w[i])) for w in weights]), F.col("bucket") + 1) for i in range(3)]
        parts = [of[0] * F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0), of[1] * F.col("word") / F.lit(float(max(n_tokens, 1))), of[2] / F.lit(float(n_types + 1))]
        total = parts[0] + parts[1] + parts[2]
        sums = events.groupBy("bucket").agg(*[F.sum(F.col("n") * p / total).alias(f"s{i}") for i, p in enumerate(parts)]).collect()
        new = [list(w) for w in weights]
        for r in sums:
            s = [r["s0"], r["s1"], r["s2"]]
            new[r["bucket"]] = [x / sum(s) for x in s]
        change = max(abs(a - b) for v, w in zip(new, weights) for a, b in zip(v, w))
        weights = new
        if change < 1e-4:
            break
    # No weight on the last resort may vanish: unseen words keep some probability.
    floor = 1e-6
    return [[w[0] * (1 - floor), w[1] * (1 - floor), w[2] * (1 - floor) + floor] for w in weights]


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema[id_column].dataType.simpleString()
    blocks = cut(docs, [id_column, text_column], text_column, "lm")
    buckets = blocks.buckets
    answers = materialize(answer(ask(blocks, _gather), _resolve, 2, 2), "ngrams")
    sums = answers.filter("block is null").agg(*[F.coalesce(F.sum(f"total_{i}"), F.lit(0)).alias(f"t{i}") for i in range(3)]).first()
    n_tokens, n_types, n_deleted = sums["t0"], sums["t1"], sums["t2"]

    def held_out_events(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(block)
        chosen = own.folds == DELETED
        rest = answered(answers, own.keys, own.second, buckets, 1, own.tally(chosen) > 0)[0].astype(np.int64)
        mine = chosen[own.doc]
        rows = np.stack([rest[own.pair[mine]], rest[own.context[mine]], rest[own.word[mine]]], axis=1)
        rows, n = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))
        return pa.table({"bucket": pa.array(frequency_bucket(rows[:, 1]), pa.int32()), "pair": pa.array(rows[:, 0]), "context": pa.array(rows[:, 1]), "word": pa.array(rows[:, 2]), "n": pa.array(n, pa.int64())})

    events = materialize(finish(blocks, answers, held_out_events, "bucket int, pair long, context long, word long, n long", 1), "events")
    # V of the reduced counts is unknown without another pass; the uniform part keeps that of all training tokens.
    weights = fit_weights(events, (n_tokens - n_deleted, n_types), rounds)

    def final(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Block(block)
        train = answered(answers, own.keys, own.second, buckets, 1)[0].astype(np.float64)
        c, pair, context = train[own.word], train[own.pair], train[own.context]
        table = np.array(weights)[frequency_bucket(context)]
        p = table[:, 0] * np.divide(pair, context, out=np.zeros_like(pair), where=context > 0) + table[:, 1] * c / max(n_tokens, 1) + table[:, 2] / (n_types + 1)
        base = np.log10((c + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
        at = own.bounds[:-1]
        reduce = lambda x: np.add.reduceat(x, at) if len(at) else x  # noqa: E731  every document has its end token
        return pa.table([own.ids, pa.array(own.folds == 0), pa.array(own.counts, pa.int64()), pa.array(reduce((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(at), n_tokens, np.int64)), pa.array(reduce(base), pa.float64()), pa.array(reduce(np.log10(p)), pa.float64())], names=[id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return finish(blocks, answers, final, SCHEMA.format(id=f"`{id_column}`", kind=kind))
