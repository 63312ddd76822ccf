"""Vectorised word splitting, hashing and exact comparison of Arrow string columns.

Words are maximal runs of bytes outside the ASCII white space 0x20 and 0x09-0x0D; in UTF-8 that is the
same as splitting by code points.  A word's hash chains its 8-byte lanes through a nonlinear bijection keyed by
its length; longer words than LANES lanes are hashed by BLAKE2b.  A window's hash joins the hashes of its halves
in the same nonlinear way, so no pattern of words cancels out.  Where a result depends on equality, ids() and
row_ids() compare the bytes and the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Eight-byte lanes of a word that are hashed here; and the low bytes that a lane of 0 to 8 bytes keeps.
LANES = 8
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def join(first: np.ndarray, second: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of two things in a row, from the hash of each."""
    return mix(mix(first ^ _SEEDS[which]) + second)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as an integer; zeros follow the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair; which picks one of several independent hashes."""
    size, lanes, seed = end - start, _lanes(data), _SEEDS[which]
    out = mix(size.astype(np.uint64) * seed + seed)
    live = None
    for lane in range(LANES):
        live = np.flatnonzero(size > 8 * lane) if live is None else live[size[live] > 8 * lane]
        if not len(live):
            break
        value = lanes[start[live] + 8 * lane] & _KEEP[np.minimum(size[live] - 8 * lane, 8)]
        out[live] = mix((out[live] ^ value) * seed)
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        own = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest()
        out[i] = np.uint64(int.from_bytes(own, "little"))
    return out


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of equal hashes, and the first place of each value's hash."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return number, first[number]


def ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Dense numbers of the byte ranges: equal exactly where the bytes are equal."""
    size, lanes = end - start, _lanes(data)
    number, head = _numbered(hash_ranges(data, start, end))
    same = bool((size == size[head]).all())
    live = np.flatnonzero(head != np.arange(len(head))) if same else size[:0]
    for lane in range(LANES):
        live = live[size[live] > 8 * lane]
        if not len(live):
            break
        differ = (lanes[start[live] + 8 * lane] ^ lanes[start[head[live]] + 8 * lane]) & _KEEP[np.minimum(size[live] - 8 * lane, 8)]
        same &= not differ.any()
    for i in live[size[live] > 8 * LANES].tolist():
        same = same and data[start[i] : end[i]].tobytes() == data[start[head[i]] : end[head[i]]].tobytes()
    if same:
        return number
    known: dict[bytes, int] = {}  # two texts share a hash: number them by their bytes
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int64)


def row_ids(columns: list[np.ndarray]) -> np.ndarray:
    """Dense numbers of the rows of some integer columns: equal exactly where all columns are equal."""
    hashes = columns[0].astype(np.uint64)
    for c in columns[1:]:
        hashes = join(hashes, c.astype(np.uint64))
    number, head = _numbered(hashes)
    if all(bool((c == c[head]).all()) for c in columns):
        return number
    return np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


class Words:
    """Words of consecutive texts: byte ranges, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.offsets = offsets
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        ink = ~_SPACE[data]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        at = offsets[:-1][offsets[:-1] < n]
        first[at] = ink[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = ink[at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self, which: int = 0) -> np.ndarray:
        return hash_ranges(self.data, self.start, self.end, which)

    def ids(self) -> np.ndarray:
        """Numbers that are equal exactly for equal words of these texts."""
        return ids(self.data, self.start, self.end)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of all windows of k values that stay inside one text."""
    room = np.maximum(np.diff(bounds) - (k - 1), 0)
    return np.arange(int(room.sum())) + np.repeat(bounds[:-1] - (np.cumsum(room) - room), room)


def windows(values: np.ndarray, bounds: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k values that stay inside one text, and their hashes from those of the values."""
    start = window_starts(bounds, k)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    out, done, part, size = None, 0, values, 1
    while True:  # the binary digits of k: parts of 1, 2, 4, ... values, joined in order
        if k & size:
            after = part[done:]
            out = after if out is None else join(out[: len(after)], after, which)
            done += size
        if done == k:
            return start, mix(out[start] ^ _SEEDS[which])
        part, size = join(part[:-size], part[size:], which), 2 * size


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one longer row: bounds working memory."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def each_slice(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    data, offsets = texts(column)
    for i, j in slices(offsets, limit):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
