"""Quality rules, line first.

Lines are the pieces between newlines that hold a word.  A line fails
  punctuation  when it holds more than one of # * $ % & | < > for every five words;
  navigation   when it has three words or fewer and no closing punctuation;
  boilerplate  when it has four words or more and more capitals than small letters (banners), or repeats
               an earlier line of the document.
Failing lines are removed.  A document is rejected when its base rules fail (fewer than 10 words, or more than
20 % of its words inside repeated 5-word windows) or when more than half of its words stand in failing lines.

Null texts count as empty and are rejected, like empty ones.  Everything is computed over the whole text, one
slice of a quarter megabyte (or one longer document) at a time; lines and windows are equal only if their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topograph.llm import textnum
from topograph.llm.common import pick

SYMBOLS = b"#*$%&|<>"
#: Closing punctuation outside ASCII, as UTF-8.
WIDE_CLOSERS = ("…", "”", "’", "»", "。", "！", "？")
#: Rules: symbols per 5 words, words of a navigation line, words of a banner, percent of words that may go.
SYMBOLS_PER_5, NAVIGATION_WORDS, BANNER_WORDS, MAX_LOST_PERCENT = 1, 3, 4, 50
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def _lookup(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _CLOSER = _lookup(SYMBOLS), _lookup(b".!?\"':;)")


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _repeated(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For numbered values with a document each, in order of documents: does it occur twice in its document."""
    _, inverse, count = np.unique(doc * (int(number.max(initial=0)) + 1) + number, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _again(data: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines equal an earlier line of their document, by their bytes."""
    raw, out, seen, now = data.tobytes(), np.zeros(len(doc), bool), set(), -1
    for i, (d, a, b) in enumerate(zip(doc.tolist(), begin.tolist(), end.tolist())):
        if d != now:
            seen, now = set(), d
        line = raw[a:b]
        out[i] = line in seen
        seen.add(line)
    return out


def measure(words: textnum.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row of COLUMNS per text; starts, ends and failures of all lines with words."""
    data, offsets = words.data, words.offsets
    n, size = len(words.counts), len(data)
    out = np.zeros((n, len(COLUMNS)), np.int64)
    ink = np.zeros(size + 1, np.int64)
    np.add.at(ink, words.start, 1)
    np.add.at(ink, words.end, -1)
    inside = np.cumsum(ink[:-1]) > 0
    of = lambda mask: np.diff(_sums(mask)[offsets])
    out[:, 0] = words.counts
    out[:, 1] = of(inside & ((data & 0xC0) != 0x80))
    symbols = _sums(_SYMBOL[data])
    out[:, 2] = np.diff(symbols[offsets])

    start, owner, word = textnum.window_starts(words.bounds, WINDOW), words.docs(), words.ids()
    twice = _repeated(owner[start], textnum.row_ids([word[start + i] for i in range(WINDOW)]))
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, start[twice], 1)
    np.add.at(cover, start[twice] + WINDOW, -1)
    out[:, 4] = np.diff(_sums(np.cumsum(cover[:-1]) > 0)[words.bounds])

    newline = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate([offsets[:-1], newline + 1])), np.sort(np.concatenate([offsets[1:], newline]))
    a, b = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    has = b > a
    begin, end, a, b = begin[has], end[has], a[has], b[has]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    again = _again(data, doc, begin, end)
    np.add.at(out[:, 3], doc, again)
    in_line = b - a
    last = words.end[b - 1]
    closed = _CLOSER[data[last - 1]]
    for mark in WIDE_CLOSERS:
        code = mark.encode()
        at = np.maximum(last - len(code), 0)
        closed |= np.logical_and.reduce([data[at + i] == c for i, c in enumerate(code)])
    latin = np.zeros(size, bool)
    latin[1:] = data[:-1] == 0xC3
    capital = ((data >= 65) & (data <= 90)) | (latin & (data >= 0x80) & (data <= 0x9E))
    small = ((data >= 97) & (data <= 122)) | (latin & (data >= 0x9F) & (data <= 0xBF))
    capitals, smalls = _sums(capital), _sums(small)
    punctuation = (symbols[end] - symbols[begin]) * 5 > in_line * SYMBOLS_PER_5
    navigation = (in_line <= NAVIGATION_WORDS) & ~closed
    banner = (in_line >= BANNER_WORDS) & (capitals[end] - capitals[begin] > smalls[end] - smalls[begin])
    fails = punctuation | navigation | banner | again
    np.add.at(out[:, 5], doc[fails], in_line[fails])
    return out, begin, end, fails


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: COLUMNS, base_failed, kept; with_text adds clean_text, the text without its failing lines (null where rejected)."""
    carry = [c for c in carry or [] if c not in (id_column, text_column)]
    slim = pick(docs, id_column, text_column, *carry)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != text_column] + [f"{c} long" for c in COLUMNS] + ["base_failed boolean, kept boolean"] + ["clean_text string"] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in textnum.each_slice(batch.column(1)):
                table, begin, end, fails = measure(words)
                n_words, repeat, lost = table[:, 0], table[:, 4], table[:, 5]
                failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
                kept = ~failed & (100 * lost <= MAX_LOST_PERCENT * n_words)
                columns = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns) if k != 1]
                columns += [pa.array(table[:, k]) for k in range(len(COLUMNS))] + [pa.array(failed), pa.array(kept)]
                if with_text:
                    columns.append(pa.array(_clean(batch.column(1).slice(i, j - i), words, begin, end, fails, kept), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != text_column] + [*COLUMNS, "base_failed", "kept"] + ["clean_text"] * with_text)

    return slim.mapInArrow(run, schema)


def _clean(texts: pa.Array, words: textnum.Words, begin: np.ndarray, end: np.ndarray, fails: np.ndarray, kept: np.ndarray) -> list[str | None]:
    bad = np.flatnonzero(fails)
    owner = np.searchsorted(words.offsets, begin[bad], side="right") - 1
    raw, out = words.data.tobytes(), []
    for k in range(len(texts)):
        if not kept[k]:
            out.append(None)
            continue
        mine = bad[np.searchsorted(owner, k) : np.searchsorted(owner, k, side="right")]
        if not len(mine):
            out.append(texts[k].as_py())
            continue
        parts, at, stop = [], int(words.offsets[k]), int(words.offsets[k + 1])
        for line in mine.tolist():
            parts.append(raw[at : int(begin[line])])
            at = min(int(end[line]) + 1, stop)
        parts.append(raw[at:stop])
        out.append(b"".join(parts).decode("utf-8"))
    return out
