"""Fill-in-middle, periodic runs and license scans against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from topograph.llm.fill_middle import UnitScanner, fill_middle, restore, restored
from topograph.llm.license_scan import NOTICES, PHRASES, license_spans, scan_licenses
from topograph.llm.periodic_runs import find_runs, periodic_runs, periodic_tail

W = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "text_ string, n long, form string, output string, words string, vote long, spans string, digest string, id long, place long, place_ double"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def texts():
    r = random.Random(11)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    out = [None, None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n漢\n😀", "x <P> y", "<M>", "x < P >", "<P", "a\0b\r\nc", " ", "one line " * 3000, "line\n" * 4000]
    out += [pick(["a", "\n", "<", "P", ">", "S", "M", "é", "漢", "😀", " ", "\r"], r.randrange(80)) for _ in range(120)]
    out += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(60)]
    out += [" ".join([r.choice("abcdef") for _ in range(r.randrange(1, 9))] * r.randrange(1, 9)) + r.choice(["", " tail of it", "\n\tend"]) for _ in range(60)]
    say = lambda n: " ".join(r.choice(["the", "license", "MIT", "under", "cc", "by", "nc", "version", "2", "apache", "Straße"]) for _ in range(n))
    out += [say(r.randrange(80)) for _ in range(60)]
    for _, notice in NOTICES:
        words = notice.split()
        out += [notice, notice.upper(), say(9) + " " + notice + "\n" + say(5), " ".join(words[: len(words) // 2]), " ".join([*words[:4], "odd", *words[4:]]), " ".join(words[:5] + words[6:]), notice + " " + notice]
    return out + ["cc by nc cc by nc by nc", "under the mit x the mit license", "under the Kit license", "UNDER THE MIT-LICENSE", "under-the/mit_license", "cc by nc"]


ROWS = [(i - 3, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (5, "again\nand\nagain"), (5, "again\nand\nagain"), (7, "cc by nc"), (7, "cc by nc"), (7, "other")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, "t", 1, "f", "o", "w", 2, "s", "d", 3, 4, 5.0) for row in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    got = collections.Counter(tuple(r) for r in df.collect())
    assert got == collections.Counter(expected), list((got - collections.Counter(expected)).items())[:3] + list((collections.Counter(expected) - got).items())[:3]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def rearranged(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(docs, empty):
    expected = [rearranged(*row) for row in ROWS]
    assert {x[2] for x in expected} == {"plain", "spm", "psm"}
    out = fill_middle(docs)
    same(out, expected)
    same(restore(out), [(i, t or "") for i, t in ROWS])
    same(fill_middle(docs, digests=True), [(*x[:5], sha(x[5]), sha(t or "")) for x, (_, t) in zip(expected, ROWS)])
    same(fill_middle(docs, rate=30), [rearranged(*row, rate=30) for row in ROWS])
    assert fill_middle(empty).collect() == [] and restore(fill_middle(empty)).collect() == []


def test_scanner_counts_in_any_lanes(monkeypatch):
    r = random.Random(2)
    raw = ["".join(r.choice(["a", "\n", "<", "P>", "<P>", "<<P>", "é", "😀"]) for _ in range(r.randrange(0, 300))).encode() for _ in range(200)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for lane in (5, 64, 10**6):
        monkeypatch.setattr("topograph.llm.fill_middle.SHORTEST_LANE", lane)
        codes = UnitScanner().scan(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for x, a, b in zip(raw, offsets, offsets[1:]):
            part = codes[a:b]
            assert int((part & 1).sum()) == len(x.decode())
            assert int((part & 2).sum()) // 2 == len(re.findall(rb"[^\n]*\n|[^\n]+", x))
            assert np.flatnonzero(part >> 2).tolist() == [m.end() - 1 for m in re.finditer(b"<P>", x)]


def test_sentinels_of_other_forms():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aXa", "aYb", "c"), ("<P>", "<P>>", "<M>"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            UnitScanner(bad)
    own = UnitScanner(("‹前›", "‹後›", "‹中›"))
    assert restored(own, ["‹前›é‹後›s‹中›m".encode(), b"plain"], ["psm", "plain"]) == ["éms".encode(), b"plain"]
    with pytest.raises(ValueError):
        restored(own, [b"nothing here"], ["spm"])


def brute_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(q % d == 0 and x[i : i + q] == x[i : i + d] * (q // d) for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    r = random.Random(4)
    for _ in range(400):
        root = [r.randrange(4) for _ in range(r.randrange(1, 25))]
        x = [7] * r.randrange(12) + root * r.randrange(1, 9) + root[: r.randrange(len(root) + 1)] + [8] * r.randrange(7)
        for _ in range(r.randrange(3)):
            x[r.randrange(len(x))] = r.randrange(4)
        yield x
        yield [r.randrange(2) for _ in range(r.randrange(90))]
        y = [r.randrange(3)]
        for _ in range(r.randrange(6)):
            y = y + [r.randrange(2)] * r.randrange(9) + y
        yield (y * 5)[r.randrange(len(y)) : 400]


def test_runs_of_repetitive_sequences():
    found = 0
    for x in sequences():
        expected = brute_runs(x)
        found += len(expected)
        assert find_runs(np.array(x, np.int64)) == expected, x
    assert found > 1000


@pytest.mark.parametrize("x", [[0] * 60_000, ([0] * 50 + [1]) * 1200, [i.bit_count() & 1 for i in range(1 << 16)], list(range(500)) * 100])
def test_runs_of_long_sequences(x):
    found = find_runs(np.array(x, np.int64))
    for start, size, q in found:
        assert x[start : start + size - q] == x[start + q : start + size]
        assert start == 0 or x[start - 1] != x[start - 1 + q]
        assert start + size == len(x) or x[start + size] != x[start + size - q]
    assert (len(found) > 0) == (len(set(x)) != 2 or x[:3] == [0, 0, 0])


def periodic(doc_id, text):
    words = W.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(W.findall(text or ""))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], "".join("%d,%d,%d\n" % r for r in runs), kept


def test_periodic_runs(docs, empty):
    short = [row for row in ROWS if len(row[1] or "") < 5000]
    expected = [periodic(*row) for row in short]
    assert sum(x[1] for x in expected) > 30 and sum(periodic_tail(i, 9) is not None for i, _ in short) > 20
    some = docs.filter("text is null or length(text) < 5000")
    same(periodic_runs(some, rewrite=periodic_tail, digests=True), [(*x[:6], sha(x[6]), sha(x[7])) for x in expected])
    rows = periodic_runs(docs).filter("doc_id = 12").collect()
    assert rows[0]["runs"][0].asDict() == {"start": 0, "length": 6000, "period": 2} and rows[0]["collapsed"] == "one line"
    assert rows[0]["exponent_milli"] == 3_000_000
    assert periodic_runs(empty).collect() == [] and periodic_runs(docs).filter("doc_id = -3").first()["n_runs"] == 0


L = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(text):
    return L.findall((text or "").translate(LOWER))


def licenses(doc_id, text, k=3, drift=4, near=8, least=0.8):
    words, base, spans = license_words(text), [], []
    for number, (label, notice) in enumerate([*PHRASES, *NOTICES]):
        own = license_words(notice)
        lines = collections.defaultdict(set)
        for p in range(len(words) - k + 1):
            for t in range(len(own) - k + 1):
                if words[p : p + k] == own[t : t + k]:
                    lines[p - t].add(t)
        share = {d: len({t + i for e in lines if abs(e - d) <= drift for t in lines[e] for i in range(k)}) / len(own) for d in lines}
        rank = {d: (share[d], len(lines[d]), -d) for d in lines}
        for d in lines:
            beside = [e for e in lines if abs(e - d) <= drift]
            if share[d] >= least and rank[d] == max(rank[e] for e in beside):
                spans.append((min(e + min(lines[e]) for e in beside), share[d], label))
        if number < len(PHRASES):
            base += [(p, label) for p in range(len(words)) if words[p : p + len(own)] == own]
    spans = [s for s in spans if s[1] >= max(o[1] for o in spans if abs(o[0] - s[0]) <= near)]
    places, found = [p for p, _ in base], {x for _, x in base}
    score = max([s[1] for s in spans] + [1.0] * bool(base), default=0.0)
    return doc_id, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(found)), ",".join(sorted(found | {s[2] for s in spans})), score


def test_license_scan(docs, empty):
    expected = [licenses(*row) for row in ROWS]
    assert {x for e in expected for x in e[6].split(",")} >= {label for label, _ in NOTICES}
    same(scan_licenses(docs).drop("spans"), expected)
    assert scan_licenses(empty).collect() == []


def test_license_spans_and_plan(docs, spark):
    notice = NOTICES[0][1]
    text = "intro words " + notice + " outro " + notice.replace("free of charge", "free of any charge")
    spans = license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    n = len(license_words(notice))
    assert [(s["first"], s["last"], s["label"]) for s in spans] == [(2, 1 + n, "mit"), (n + 3, 2 * n + 3, "mit")]
    assert spans[0]["share"] == 1.0 and 0.8 < spans[1]["share"] <= 1.0
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Scan ExistingRDD")[0]) and "BroadcastHashJoin" in plan
