"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged across, so a cut
between the two is certain.  Texts are first cut where such a cut coincides with a piece boundary of the tokenizer's
own splitting pattern: before ASCII white space that follows a byte other than white space (that
pattern never keeps ink and following white space in one piece, and looks ahead only at the end of a
run of white space).  Each distinct fragment is then split into the pattern's pieces, every piece is cut at all its
certain cuts, and what lies between them is merged independently, once per worker, and concatenated.
Fragments that hold an added token (a special string) are encoded by the library.

Null texts count as empty; empty texts have no tokens; a text of any length is encoded whole.  Repeated rows are encoded like any others.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from topograph.llm.common import pick

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fragments of a generation that a worker remembers (the one before is kept too, so frequent ones stay), and bytes of a fragment.
MEMO_ENTRIES, MEMO_FRAGMENT = 300_000, 64
#: The pieces of byte-level splitting, fixed by the published format; used for texts of SAFE characters, whose Unicode classes
#: don't differ between versions of Unicode. The pieces of other texts are the library's.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = r"[\t\n\r\x20-\x7e\u00a1-\u017f]*"

#: UTF-8 endings of white space outside ASCII, fixed by Unicode; no cut follows them.
_WIDE_SPACE = (rb"\xc2\x85", rb"\xc2\xa0", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encodes and decodes with a byte-level tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.piece: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special} | special
        self.pairs = {pair for i, p in self.piece.items() if i not in special for pair in zip(p, p[1:])}
        letter = {b: c for c, b in alphabet.items()}
        self.inner = {letter[a] + letter[b] for a, b in self.pairs}
        self.added = re.compile("|".join(re.escape(t.decode()) for t in special.values()) or r"(?!)")
        # Pieces are merged one by one only where nothing but the pattern comes before the merges.
        self.plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.safe, self.pieces = re.compile(SAFE).fullmatch, regex.compile(PIECES).findall
        self.letters = {b: ord(c) for c, b in alphabet.items()}
        self.fragments = re.compile(self._pattern()).findall
        self._memo: dict[bytes, bytes] = {}
        self._before: dict[bytes, bytes] = {}
        self._known_pieces: dict[str, bytes] = {}

    def _pattern(self) -> bytes:
        space = b"\x09-\x0d\x20"
        unsafe = sorted({a for a, b in self.pairs if b in b" \t\n\x0b\x0c\r" and a not in b" \t\n\x0b\x0c\r"} | {0x1C, 0x1D, 0x1E, 0x1F})
        ends = [b"[" + b"".join(b"\\x%02x" % a for a in unsafe) + b"]", *_WIDE_SPACE]
        behind = b"|".join(b"(?<=%s)" % e for e in ends)
        return b"[%s]*[^%s]+(?:(?:%s)[%s]+[^%s]*)*|[%s]+" % (space, space, behind, space, space, space)

    def parts(self, piece: str) -> list[str]:
        """A piece, in the vocabulary's letters, cut at all its certain cuts."""
        inner = self.inner
        cuts = [0, *[i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in inner], len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:])]

    def _fragment_ids(self, fragment: bytes) -> bytes:
        if (packed := self._before.get(fragment)) is None:
            text = fragment.decode("utf-8")
            if not self.plain or self.added.search(text):
                ids = self.library.encode(text, add_special_tokens=False).ids
                packed = struct.pack(f"<{len(ids)}I", *ids)
            else:
                pieces = self.pieces(text) if self.safe(text) else [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
                known = self._known_pieces.get
                packed = b"".join([known(p) or self._piece_ids(p) for p in pieces])
        if len(fragment) <= MEMO_FRAGMENT:
            if len(self._memo) >= MEMO_ENTRIES:
                self._memo, self._before = {}, self._memo
            self._memo[fragment] = packed
        return packed

    def _piece_ids(self, piece: str) -> bytes:
        merge = self.library.model.tokenize
        ids = [t.id for part in self.parts(piece.encode("utf-8").decode("latin-1").translate(self.letters)) for t in merge(part)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_FRAGMENT:
            if len(self._known_pieces) >= MEMO_ENTRIES:
                self._known_pieces.clear()
            self._known_pieces[piece] = packed
        return packed

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, miss = self._memo.get, self._fragment_ids
        return b"".join([got if (got := get(f)) is not None else miss(f) for f in self.fragments(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def coder_for(path: str) -> ForcedBoundaryBPE:
    """One per worker process, so that tasks share the tokenizer and the remembered fragments."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, digests of the ids and of the decoded text; with_ids adds the ids and the decoded text.

    The tokenizer file must be at the same path on every executor.
    """
    schema = SCHEMA.replace("doc_id", f"`{id_column}`") + (", token_ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder_for(tokenizer_path)
        for batch in batches:
            n, ids_hex, text_hex, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_buffer().to_pybytes() if text.is_valid else b"")
                back = bpe.decode(ids)
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<i4"))
                    decoded.append(back)
            columns = {id_column: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if with_ids:
                columns |= {"token_ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    slim = pick(docs, id_column, text_column)
    return slim.mapInArrow(run, schema.replace(f"`{id_column}` long", f"`{id_column}` {slim.schema[0].dataType.simpleString()}"))
