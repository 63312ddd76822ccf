"""Periodic runs of words by block matching.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbouring word extends.
For every scale B = 1, 2, 4, ..., the blocks of B words that begin at multiples of B are keys (sequences of word
numbers) of an Aho-Corasick automaton, which is searched across the document.  A period q with B <= q < 2 B belongs to
scale B: a run of it is at least 4 q words long, so it holds an aligned block within its first 2 B - 1 words, and that
block occurs again q words later.  Occurrences at such distances are seeds, each extended word by word in both
directions as long as words q apart are the same.  A stretch that has a smaller period is dropped: it is found at the
scale of that period.

Nothing is lost by what is left out before:
- a block is no key unless all of its words and the B that follow occur again less than 2 B words later, as they do in a run;
- a block is no key inside a run of a smaller scale that covers all words a seed of it could touch: two periods
  would have a smaller one in common, so the stretch of the seed lies in the run;
- a seed is not extended where a hash shows that it doesn't go on for three periods, as the first aligned block of a run does;
- nor where a stretch with its period, found before, covers it.

Words are numbered by their bytes, so equal numbers are equal words.  Null texts have no words.  Texts are read
whole; memory is a few dozen bytes a word of a slice (a quarter megabyte of text, or one longer text).  Repeated rows each give the same row.
Other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topograph.llm import textnum
from topograph.llm.common import pick

#: A run has this many periods at least, and this many words.
PERIODS, WORDS = 4, 6
#: A prime for the hash of word sequences, and its base.
_PRIME, _BASE = np.uint64((1 << 31) - 1), 1_103_515_245
_CHUNK = 64

Run = tuple[int, int, int]
#: From an identifier and a number of words: which word stands at each place, or None for the text as it is.
Rewrite = Callable[[object, int], "np.ndarray | None"]


class _Hashes:
    """Equality of stretches of one sequence, but for collisions."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.power = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:  # powers by doubling
            factor = np.uint64(pow(_BASE, done, int(_PRIME)))
            self.power[done : 2 * done] = self.power[: min(done, n + 1 - done)] * factor % _PRIME
            done *= 2
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(textnum.mix(x.astype(np.uint64) + np.uint64(1)) % _PRIME * self.power[:n] % _PRIME, out=self.sums[1:])
        self.sums %= _PRIME

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Do the stretches of these sizes at a and at b >= a look the same?"""
        left = (self.sums[a + size] + _PRIME - self.sums[a]) % _PRIME * self.power[b - a] % _PRIME
        return left == (self.sums[b + size] + _PRIME - self.sums[b]) % _PRIME


def _recurrence(x: np.ndarray) -> np.ndarray:
    """For each place, how far on its word stands next (len(x) if nowhere)."""
    order = np.argsort(x, kind="stable")
    gap = np.full(len(x), len(x), np.int64)
    again = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    return gap


def _seeds(x: np.ndarray, block: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks, and distances in [block, 2 block) at which the automaton finds them again."""
    n, held = len(x), ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    words, number = x.tolist(), {}
    for p in starts.tolist():
        key = tuple(words[p : p + block])
        number[p] = held.get(key, len(number))
        held.add_word(key, number[p])
    held.make_automaton()
    at, distance = [], []
    edge = np.flatnonzero(np.diff(starts) > 2 * block)  # blocks further apart are searched for apart
    firsts, lasts = starts[np.concatenate([[0], edge + 1])], starts[np.concatenate([edge, [len(starts) - 1]])]
    for low, high in zip(firsts.tolist(), lasts.tolist()):
        low, high = low + block, min(high + 3 * block - 1, n)
        for end, which in held.iter(tuple(words[low:high])):
            start = low + end - block + 1
            p = (start // block - 1) * block  # the one aligned block at a distance of this scale
            if number.get(p) == which:
                at.append(p)
                distance.append(start - p)
    return np.array(at, np.int64), np.array(distance, np.int64)


def _reach(x: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The longest stretch of places around p, as a range of i, in which x[i] == x[i + q]."""
    low, high, size, n = p, p, _CHUNK, len(x) - q
    while low > 0:
        a = max(low - size, 0)
        differ = np.flatnonzero(x[a:low] != x[a + q : low + q])
        if len(differ):
            low = a + int(differ[-1]) + 1
            break
        low, size = a, 2 * size
    size = _CHUNK
    while high < n:
        b = min(high + size, n)
        differ = np.flatnonzero(x[high:b] != x[high + q : b + q])
        if len(differ):
            high += int(differ[0])
            break
        high, size = b, 2 * size
    return low, high


def _primitive(root: np.ndarray) -> bool:
    """Is it no repetition of a shorter sequence?"""
    q = len(root)
    return not any(q % d == 0 and bool((root[d:] == root[:-d]).all()) for d in range(1, q // 2 + 1))


class _Cover:
    """Stretches in order of their starts, none within another."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and b <= self.ends[i]

    @classmethod
    def of(cls, stretches: list[tuple[int, int]]) -> _Cover:
        made = cls()
        for a, b in sorted(stretches, key=lambda s: (s[0], -s[1])):
            if not made.ends or b > made.ends[-1]:
                made.starts.append(a)
                made.ends.append(b)
        return made


def find_runs(x: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    n, runs, block = len(x), [], 1
    if n < WORDS:
        return runs
    gap, hashes = _recurrence(x), None
    while PERIODS * block <= n:
        far = np.zeros(n + 1, np.int64)
        np.cumsum(gap >= 2 * block, out=far[1:])
        starts = np.arange(0, n - 3 * block + 1, block)
        starts = starts[far[starts + 2 * block] == far[starts]]
        if len(starts) and runs:  # of smaller scales
            cover = _Cover.of([(s, s + size) for s, size, _ in runs])
            starts = np.array([p for p in starts.tolist() if not cover.holds(p, min(p + 3 * block, n))], np.int64)
        if len(starts):
            at, q = _seeds(x, block, starts)
            fits = at + 3 * q <= n
            at, q = at[fits], q[fits]
            if len(at):
                hashes = hashes or _Hashes(x)
                goes_on = hashes.same(at, at + q, 2 * q)
                runs += _extended(x, at[goes_on], q[goes_on])
        block *= 2
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def _extended(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> Iterator[Run]:
    order = np.lexsort((at, q))
    period, end = 0, 0
    for p, d in zip(at[order].tolist(), q[order].tolist()):
        if d == period and p < end:
            continue
        low, high = _reach(x, p, d)
        period, end = d, high
        size = high - low + d
        if size >= max(WORDS, PERIODS * d) and _primitive(x[low : low + d]):
            yield low, size, d


def periodic_tail(identifier: object, n: int) -> np.ndarray | None:
    """A tenth of all texts get a tail that repeats its beginning, drawn from the CRC-32 of the identifier; an empty one if null."""
    g, rest = divmod(zlib.crc32(b"" if identifier is None else str(identifier).encode()), 10)
    if rest or not n:
        return None
    place = np.arange(n)
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return np.where(place < first, place, first + (place - first) % period)


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long"


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, rewrite: Rewrite | None = None, digests: bool = False) -> DataFrame:
    """One row per document: identifier, n_runs, the longest run (ties: first start, then period; nulls if none), then all runs
    and the text without repetitions (the words of a run after its first period dropped, the others joined by one space);
    with digests, the SHA-256 of both instead."""
    slim = pick(docs, id_column, text_column)
    last = "runs_sha256 string, collapsed_sha256 string" if digests else "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    schema = f"`{id_column}` {slim.schema[0].dataType.simpleString()}, {COLUMNS}, {last}"
    names = [id_column, *(x.split()[0] for x in COLUMNS.split(", ")), *(("runs_sha256", "collapsed_sha256") if digests else ("runs", "collapsed"))]
    kinds = [pa.int64()] * 5 + ([pa.string()] * 2 if digests else [pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])), pa.string()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in textnum.each_slice(batch.column(1)):
                ids = batch.column(0).slice(i, j - i)
                raw, number, start, end = words.data.tobytes(), words.ids(), words.start.tolist(), words.end.tolist()
                rows = []
                for k, identifier in enumerate(ids.to_pylist()):
                    first, n = int(words.bounds[k]), int(words.counts[k])
                    place = rewrite(identifier, n) if rewrite else None
                    place = first + (np.arange(n) if place is None else place)
                    found = find_runs(number[place])
                    keep = np.ones(n, bool)
                    for s, size, q in found:
                        keep[s + q : s + size] = False
                    collapsed = b" ".join(raw[start[w] : end[w]] for w in compress(place.tolist(), keep.tolist()))
                    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    if digests:
                        listed = "".join(f"{s},{size},{q}\n" for s, size, q in found).encode()
                        rows.append((len(found), *own, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
                    else:
                        rows.append((len(found), *own, [dict(zip(("start", "length", "period"), r)) for r in found], collapsed.decode()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    return slim.mapInArrow(run, schema)
