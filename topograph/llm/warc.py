"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing: one record per page, one gzip member per record.  Among pages with equal payloads of at least
min_revisit bytes the one with the largest page_id is the response and the others are revisits that refer to it;
a page without a page_id comes last, and of repeated rows one is the response.  Equal payloads are found by
sorting their digests (runs.py), so a payload shared by any number of pages fills no single task.

Reading: a record counts only after its checks (gzip check sum, version line, lengths, payload digest).  After a
failed check the reader searches on for the next valid member or version line, goes on from there, and reports
the bytes in between as a quarantined gap.  Null html counts as an empty payload; null urls have no target header;
an empty table writes and reads no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topograph.llm.common import scratch_path
from topograph.llm.runs import equal_runs

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_start long, gap_end long, gap_reason string"
#: Bytes of an archive file, unless a single record has more: a reading task holds one file.
FILE_BYTES = 64 << 20
#: Rows of a batch that a reading task gives back.
ROWS = 1000
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def _record_id(page_id: object) -> str:
    h = hashlib.md5(f"page|{page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A whole WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member. The last byte is always 0: large members, whose length field could end otherwise, are followed by an empty one."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = press.compress(data) + press.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Writes the archives to a folder that all executors reach."""
    html = F.coalesce(F.col(f"`{html_column}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("__equal", F.sha2("html", 256))
    runs = equal_runs(rows, F.col("__equal"), [F.col("page_id").desc_nulls_last()], "page_id", "payloads", drop=["__equal"])
    revisit = (F.octet_length("html") >= min_revisit) & ~F.col("is_head")
    rows = runs.select("page_id", "url", "html", "digest", F.col("run_head").alias("refers_to"), revisit.alias("revisit"))

    limit = FILE_BYTES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            page, url, html, digest, refers, again = (batch.column(i) for i in range(6))
            out = [
                member(record(page[i].as_py(), url[i].as_py(), html[i].as_buffer().to_pybytes(), digest[i].as_py(), refers[i].as_py(), again[i].as_py(), date))[:-1]
                for i in range(batch.num_rows)
            ]
            files = []
            for data in out:
                if size and size + len(data) > limit:
                    file, size = file + 1, 0
                size += len(data)
                files.append(file)
            yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary()), "archive": pa.array(files, pa.int64())})

    # The text sink copies a string's bytes as they are; its line separator is the 0 with which every member ends.
    members = rows.mapInArrow(build, "member binary, archive long").select(F.col("member").cast("string").alias("value"), "archive")
    members.write.option("lineSep", "\x00").option("compression", "none").partitionBy("archive").text(path)


class Record(NamedTuple):
    """A record and its place, or that of the member that holds it."""

    head: dict[str, str]
    block: bytes
    begin: int
    end: int


class Gap(NamedTuple):
    """A quarantined range of bytes."""

    begin: int
    end: int
    reason: str


@dataclass
class Salvage:
    """Records and gaps of one archive file."""

    records: list[tuple[dict[str, str], bytes]] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)  # of each record, or of the member that holds it
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _member_at(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at a position holds, where it ends, and whether it is whole and passes its check."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and pos < len(data):
            out.append(inflate.decompress(data[pos : pos + 65536]))
            pos += 65536
    except zlib.error:
        return b"".join(out), at, False
    if not inflate.eof:
        return b"".join(out), at, False
    return b"".join(out), min(pos, len(data)) - len(inflate.unused_data), True


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """The record that begins at a version line, or why there is none."""
    if not re.match(rb"WARC/\d\.\d\r\n", data[at : at + 16]):
        return "no version line"
    if (stop := data.find(b"\r\n\r\n", at)) < 0:
        return "no end of header"
    head: dict[str, str] = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return "bad header line"
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        return "no length"
    begin, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    block = data[begin:end]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and len(digest) == 45 and hashlib.sha1(block).hexdigest() != digest[5:].lower():
        return "wrong block digest"
    return head, block, end + 4


def _inside(data: bytes, begin: int, end: int, whole: bool = True) -> Iterator[Record | Gap]:
    """The records of a member that lies at [begin, end) in the file; they and gaps between them are given its place."""
    at = 0
    while at < len(data):
        got = _record_at(data, at)
        if not isinstance(got, str):
            yield Record(*got[:2], begin, end)
            at = got[2]
            continue
        nxt = at + 1
        while (nxt := data.find(b"WARC/", nxt)) >= 0 and isinstance(_record_at(data, nxt), str):
            nxt += 1
        nxt = len(data) if nxt < 0 else nxt
        if whole or nxt < len(data):
            yield Gap(begin, end, got)
        at = nxt


def salvaged(content: bytes) -> Iterator[Record | Gap]:
    """Reads an archive file, compressed, plain or mixed, through any damage: one record or gap at a time, so that no more than a
    member's records are held. Each position where a member or version line could begin is tried once while a gap is open."""
    at, view, n = 0, memoryview(content), len(content)
    bad, reason = -1, ""  # where the open gap began
    while at < n:
        good: Iterable[Record | Gap] = ()
        end, why = -1, "no member or version line"
        if content[at : at + 3] == b"\x1f\x8b\x08":
            data, stop, whole = _member_at(view, at)
            if whole:
                good, end = _inside(data, at, stop), stop
            elif bad < 0 and data:
                yield from _inside(data, at, n, whole=False)  # records that were complete before the damage
            why = "bad gzip member"
        elif content[at : at + 5] == b"WARC/":
            got = _record_at(content, at)
            if isinstance(got, str):
                why = got
            else:
                good, end = [Record(*got[:2], at, got[2])], got[2]
        if end >= 0:
            if bad >= 0:
                yield Gap(bad, at, reason)
                bad = -1
            yield from good
            at = end
            continue
        if bad < 0:
            bad, reason = at, why
        found = [p for p in (content.find(b"\x1f\x8b\x08", at + 1), content.find(b"WARC/", at + 1)) if p >= 0]
        at = min(found, default=n)
    if bad >= 0:
        yield Gap(bad, n, reason)


def salvage(content: bytes) -> Salvage:
    """Everything salvaged() finds."""
    out = Salvage()
    for x in salvaged(content):
        if isinstance(x, Gap):
            out.gaps.append(tuple(x))
        else:
            out.records.append((x.head, x.block))
            out.places.append((x.begin, x.end))
    return out


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    http, gap, body = block.partition(b"\r\n\r\n")
    return body if gap and http.startswith(b"HTTP/") else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all archives in a folder; rows with gap_start are quarantined byte ranges instead."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None
        schema = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string())])

        def row(name: str, x: Record | Gap) -> tuple:
            if isinstance(x, Gap):
                return (name, None, None, None, None, None, None, *x)
            kind, digest = x.head.get("warc-type"), x.head.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "revisit":
                length = re.search(rb"\r\nContent-Length: *(\d+)", x.block, re.I)
                size = int(length[1]) if length else None
            else:
                payload = payload_of(x.head, x.block)
                size, own = len(payload), hashlib.sha1(payload).hexdigest()
                if digest and own != digest:
                    return (name, None, None, None, None, None, None, x.begin, x.end, f"wrong payload digest of page {x.head.get('page-id')}")
                digest = own
            return (name, number(x.head.get("page-id")), x.head.get("warc-target-uri"), size, digest, kind, number(x.head.get("refers-to-page-id")), None, None, None)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = salvaged(content.as_buffer().to_pybytes())
                while rows := [row(name, x) for x in islice(found, ROWS)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, READ_SCHEMA)


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the pages and reads the archives back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
