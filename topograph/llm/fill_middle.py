"""Fill-in-middle rearrangement with one table-driven scan over bytes.

A text is cut into units (lines with their newline), and three runs of units, the prefix, the middle and the suffix,
are put in another order behind sentinels:
  psm    <P>prefix<S>suffix<M>middle
  spm    <S>suffix<P>prefix<M>middle
  plain  the text as it is, where it is empty, holds a sentinel already, or isn't picked.

The scan is a finite automaton over bytes: a state knows how many continuation bytes of a UTF-8 character are still
due, whether the next byte opens a unit, and how much of a sentinel has just been read.  Each transition is numbered by
what it counts (a character begins, a unit begins, a sentinel ends); the scan emits these numbers, their counts per
text decide the form, and a second pass finds the bytes of the cuts among them.  The state depends on the last few bytes
only, so long streams are read in parallel lanes, each of which first reads the few bytes before it.

The cuts are drawn from the SHA-256 of "seed:identifier"; reruns and any partitioning agree.  The original text follows from output and
form alone (restore()).  Null texts count as empty and become plain ones with n = 0 and the output ''; a null identifier
is drawn for as an empty one.  Texts of any length are read whole, in slices of a quarter megabyte or one longer text.
Repeated rows each give the same row.  Other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topograph.llm import textnum
from topograph.llm.common import pick

SENTINELS = ("<P>", "<S>", "<M>")
#: What a transition counts: a character, a unit; above them, the number of the sentinel it ends (from 1).
CHARACTER, UNIT, SENTINEL_SHIFT = 1, 2, 2
_BOUNDARY = 256
#: Lanes of a scan are about as many as each is long, but not shorter than this.
SHORTEST_LANE = 64


class UnitScanner:
    """The automaton for lines, UTF-8 characters and some sentinels."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS):
        self.sentinels = [s.encode() for s in sentinels]
        _unambiguous(self.sentinels)
        prefixes = {s[:i] for s in self.sentinels for i in range(len(s))}
        self.depth = max(4, *map(len, self.sentinels))  # so many bytes fix the state, whatever it was before them

        def step(state: tuple[int, bool, bytes], byte: int) -> tuple[tuple[int, bool, bytes], int]:
            due, opens, read = state
            if byte == _BOUNDARY:
                return (0, True, b""), 0
            counts = UNIT if opens else 0
            if 0x80 <= byte < 0xC0:
                due = max(due - 1, 0)
            else:
                counts |= CHARACTER
                due = (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
            read += bytes([byte])
            if read in self.sentinels:
                counts |= (self.sentinels.index(read) + 1) << SENTINEL_SHIFT
            while read not in prefixes:
                read = read[1:]
            return (due, byte == 10, read), counts

        states = {(0, True, b""): 0}
        rows = []
        for state in (queue := list(states)):
            row = []
            for byte in range(_BOUNDARY + 1):
                after, counts = step(state, byte)
                if after not in states:
                    states[after] = len(states)
                    queue.append(after)
                row.append((states[after], counts))
            rows.append(row)
        table = np.array(rows)  # state, byte, (next state, counts)
        # bytes with the same column in every state share a class
        _, first, self.class_of = np.unique(table.transpose(1, 0, 2).reshape(_BOUNDARY + 1, -1), axis=0, return_index=True, return_inverse=True)
        self.class_of = self.class_of.reshape(-1).astype(np.uint8)
        self.width = len(first)
        self.next = (table[:, first, 0] * self.width).astype(np.int32).reshape(-1)  # rows by their offset
        self.counts = table[:, first, 1].astype(np.uint8).reshape(-1)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """What the transition over each byte counts; data holds the texts between offsets."""
        boundary = self.class_of[_BOUNDARY]
        at = offsets[:-1] + np.arange(len(offsets) - 1)
        total = len(data) + len(at)
        inside = np.ones(total, bool)
        inside[at] = False
        lane = max(SHORTEST_LANE, math.isqrt(total))
        lanes = -(-total // lane)
        stream = np.full(self.depth + lanes * lane, boundary, np.uint8)
        stream[self.depth : self.depth + total][inside] = self.class_of[data]
        before = np.stack([stream[i : i + lanes * lane : lane] for i in range(self.depth)]) if lanes else np.zeros((0, 0), np.uint8)
        body = np.ascontiguousarray(stream[self.depth :].reshape(lanes, lane).T)
        state = np.zeros(lanes, np.int32)
        for column in before:
            state = self.next[state + column]
        out = np.empty_like(body)
        for i, column in enumerate(body):
            edge = state + column
            out[i] = self.counts[edge]
            state = self.next[edge]
        return out.T.reshape(-1)[:total][inside]


def _unambiguous(sentinels: list[bytes]) -> None:
    """Neither a sentinel and its neighbours nor a sentinel and text may form another one."""
    for a in sentinels:
        for i, b in enumerate(sentinels):
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or overlap or (a in b and a is not sentinels[i]):
                raise ValueError("sentinels must be distinct, not empty, and must not overlap")


def _drawn(seed: int, identifier: object) -> list[int]:
    """The first four groups of eight hexadecimal digits of the hash for an identifier."""
    digest = hashlib.sha256(f"{seed}:{'' if identifier is None else identifier}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


class Rearranged:
    """The outputs of consecutive texts."""

    def __init__(self, scanner: UnitScanner, ids: list, data: np.ndarray, offsets: np.ndarray, seed: int, rate: int, spm_rate: int):
        codes = scanner.scan(data, offsets)
        units = np.flatnonzero(codes & UNIT)
        first = np.searchsorted(units, offsets)
        characters = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(codes & CHARACTER, out=characters[1:])
        marked = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(codes >> SENTINEL_SHIFT > 0, out=marked[1:])
        self.n = np.diff(first)
        holds = np.diff(marked[offsets]) > 0
        raw, (pre, suf, mid) = data.tobytes(), scanner.sentinels
        self.forms, self.prefix, self.middle, self.outputs = [], [], [], []
        for k, identifier in enumerate(ids):
            begin, end, n = int(offsets[k]), int(offsets[k + 1]), int(self.n[k])
            h1, h2, h3, h4 = _drawn(seed, identifier)
            if begin == end or holds[k] or h3 % 100 >= rate:
                self._add("plain", None, None, raw[begin:end])
                continue
            a, b = (int(units[first[k] + c]) if c < n else end for c in sorted((h1 % (n + 1), h2 % (n + 1))))
            parts = raw[begin:a], raw[a:b], raw[b:end]
            chars = int(characters[a] - characters[begin]), int(characters[b] - characters[a])
            if h4 % 100 < spm_rate:
                self._add("spm", *chars, suf + parts[2] + pre + parts[0] + mid + parts[1])
            else:
                self._add("psm", *chars, pre + parts[0] + suf + parts[2] + mid + parts[1])

    def _add(self, form: str, prefix: int | None, middle: int | None, output: bytes) -> None:
        self.forms.append(form)
        self.prefix.append(prefix)
        self.middle.append(middle)
        self.outputs.append(output)


def restored(scanner: UnitScanner, outputs: Sequence[bytes], forms: Sequence[str]) -> list[bytes]:
    """The original texts, from outputs and forms alone; an output without its three sentinels is an error."""
    offsets = np.zeros(len(outputs) + 1, np.int64)
    np.cumsum([len(x) for x in outputs], out=offsets[1:])
    codes = scanner.scan(np.frombuffer(b"".join(outputs), np.uint8), offsets) >> SENTINEL_SHIFT
    ends = np.flatnonzero(codes)
    bounds, texts = np.searchsorted(ends, offsets), []
    for k, (output, form) in enumerate(zip(outputs, forms, strict=True)):
        if form == "plain":
            texts.append(output)
            continue
        found = [(int(codes[e]) - 1, int(e - offsets[k]) + 1) for e in ends[bounds[k] : bounds[k + 1]].tolist()]
        if [which for which, _ in found] != ([0, 1, 2] if form == "psm" else [1, 0, 2]):
            raise ValueError(f"not a {form} output: {len(found)} sentinels, or in another order")
        stops = [end - len(scanner.sentinels[which]) for which, end in found[1:]] + [len(output)]
        part = {which: output[end:stop] for (which, end), stop in zip(found, stops, strict=True)}
        texts.append(part[0] + part[2] + part[1])
    return texts


def _percent(name: str, value: int) -> None:
    if not 0 <= value <= 100:
        raise ValueError(f"{name} is a percentage")


def fill_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: Sequence[str] = SENTINELS, digests: bool = False) -> DataFrame:
    """One row per document: identifier, n (units), form, prefix_chars, middle_chars (null where plain), and the output; with
    digests, the SHA-256 of the output and of the text restored from it instead."""
    _percent("rate", rate)
    _percent("spm_rate", spm_rate)
    slim = pick(docs, id_column, text_column)
    last = "output_sha256 string, restored_sha256 string" if digests else "output string"
    schema = f"`{id_column}` {slim.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, {last}"
    names = [id_column, "n", "form", "prefix_chars", "middle_chars", *(x.split()[0] for x in last.split(", "))]
    sentinels = tuple(sentinels)
    UnitScanner(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = UnitScanner(sentinels)
        for batch in batches:
            data, offsets = textnum.texts(batch.column(1))
            for i, j in textnum.slices(offsets):
                ids = batch.column(0).slice(i, j - i)
                made = Rearranged(scanner, ids.to_pylist(), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], seed, rate, spm_rate)
                columns = [ids, pa.array(made.n, pa.int64()), pa.array(made.forms, pa.string()), pa.array(made.prefix, pa.int64()), pa.array(made.middle, pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (made.outputs, restored(scanner, made.outputs, made.forms))]
                else:
                    columns.append(pa.array(made.outputs, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, schema)


def restore(rearranged: DataFrame, id_column: str = "doc_id", *, output_column: str = "output", form_column: str = "form", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Identifier and text of each row of fill_middle()'s result; null outputs stay null."""
    slim = pick(rearranged, id_column, output_column, form_column)
    sentinels = tuple(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = UnitScanner(sentinels)
        for batch in batches:
            outputs, forms = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            texts = restored(scanner, [x or b"" for x in outputs], ["plain" if x is None else f for x, f in zip(outputs, forms)])
            own = pa.array([None if x is None else t for x, t in zip(outputs, texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), own], names=[id_column, "text"])

    return slim.mapInArrow(run, f"`{id_column}` {slim.schema[0].dataType.simpleString()}, text string")
