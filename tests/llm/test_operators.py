"""Each operator against brute force on a small table with every awkward case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "size long, kept boolean, uid long, block long, key string, n_words long, place long, target double, is_head boolean, n_tokens long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(text):
    return W.findall(text or "")


def documents():
    """Copies, near copies, shared passages, nulls, empty and blank texts, a long text, repeated rows; shuffled."""
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "naïve", "漢字", "The", "end.", "a b"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(40)
    near = [" ".join(w if r.random() > p else "edit%d" % r.randrange(99) for w in base.split()) for p in (0.005, 0.01, 0.02, 0.03, 0.05, 0.08)]
    texts = [base, base, base + "\n", base.replace(" ", "\t"), *near, None, None, "", "  \n", "one", "One", "a b c", "a b c", say(6000), "x" * 9000,
             "!!! ### $$$\n" * 20, "Same line here now.\nSame line here now.\n" + say(30) + "."]
    texts += [say(r.randrange(1, 90)) + "\n" + passage + "\n" + say(r.randrange(1, 60)) + "." for _ in range(12)]
    texts += [say(r.randrange(1, 200)) for _ in range(30)]
    rows = [(i, t, "en", r.choice(["src0", "src0", "src0", "src1", "src2", None]), len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, 1, True, 2, 3, "k", 4, 5, 6.0, False, 7) for x in rows], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {x["doc_id"]: x for x in df.collect()}


def test_words_and_hashes_of_slices():
    import pyarrow as pa

    from topograph.llm import textnum

    texts = ["", "a b", None, " ", "Ab", "ab ", "a\x0bb", "é à"]
    known = {}
    for i, j, w in textnum.each_slice(pa.array(texts), limit=3):
        h = w.hashes().tolist()
        for d in range(i, j):
            own = words(texts[d])
            assert len(own) == w.counts[d - i]
            for word, value in zip(own, h[w.bounds[d - i] : w.bounds[d - i + 1]]):
                assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_exact_dedup(docs, rows, empty):
    from topograph.llm.exact_dedup import exact_dedup

    got, groups = by_id(exact_dedup(docs)), collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            x = got[i]
            assert (x["keep_id"], x["group_size"], x["kept"]) == (min(members)[1], len(members), i == min(members)[1])
            assert x["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    from topograph.llm.exact_dedup import exact_dedup, keep_one

    df = spark.createDataFrame([(1, "a b")] * 500 + [(None, "c")] * 3 + [(None, None)], "doc_id long, text string").repartition(7)
    assert exact_dedup(df).filter("kept").count() == 3
    assert sorted(map(str, keep_one(df).collect())) == sorted(["Row(doc_id=1, text='a b')", "Row(doc_id=None, text='c')", "Row(doc_id=None, text=None)"])


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return sets, {i: root(i) for i in sets}


def test_near_dedup(docs, rows, empty):
    from topograph.llm.near_dedup import near_dedup

    got = by_id(near_dedup(docs))
    sets, roots = near_components(rows)
    for i, own in sets.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(own), roots[i], roots[i] == i)
    assert near_dedup(empty).count() == 0


def test_near_dedup_finds_chains_in_crowded_buckets(spark):
    """A family whose members are close to some but not all others, larger than a block."""
    from topograph.llm import near_dedup as nd

    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(60)] = f"e{r.randrange(12)}"
        rows.append((i, " ".join(own)))
    before, nd.BLOCK = nd.BLOCK, 16
    try:
        got = by_id(nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    finally:
        nd.BLOCK = before
    _, roots = near_components(rows)
    assert {i: x["component_id"] for i, x in got.items()} == roots


def test_near_dedup_keeps_one_row_of_each_component(spark):
    from topograph.llm.near_dedup import keep_one

    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x y"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(x["doc_id"] if x["doc_id"] is not None else -1 for x in keep_one(df).collect()) == [-1, -1, 1, 2]


def test_signatures_within_the_guaranteed_distance_share_a_key():
    from topograph.llm.near_dedup import CHUNKS, LENGTH, index_keys

    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 1 << 16, LENGTH, dtype=np.uint16)
        b = a.copy()
        at = r.choice(LENGTH, 2 * CHUNKS - 1, replace=False)
        b[at] ^= r.integers(1, 1 << 16, len(at), dtype=np.uint16)
        keys = index_keys(np.stack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_substring_dedup(docs, rows, empty):
    from topograph.llm.substring_dedup import substring_dedup

    got, seen = by_id(substring_dedup(docs, with_text=True)), set()
    for i, t, *_ in sorted(rows):
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone |= set(range(s, s + 20))
            seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        x = got[i]
        assert (x["n_words"], x["n_removed"], x["kept_text"]) == (len(w), len(gone), kept)
        assert x["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert set().union(*[range(s["start"], s["end"]) for s in x["removed_spans"]]) == gone
    assert substring_dedup(empty).count() == 0


def test_quality(docs, rows, empty):
    from topograph.llm.quality import quality

    got = by_id(quality(docs, with_text=True))
    for i, t, *_ in rows:
        t = t or ""
        w, x = words(t), got[i]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = collections.Counter(grams)
        cover = {k + o for k, g in enumerate(grams) if count[g] > 1 for o in range(5)}
        lines = [line for line in t.split("\n") if words(line)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert x["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (x["kept"] and x["base_failed"]) and (x["clean_text"] is not None) == x["kept"]
    assert quality(empty).count() == 0


def test_quality_removes_failing_lines(spark):
    from topograph.llm.quality import quality

    good = "This is a plain sentence with enough words to be kept by every rule."
    text = f"Home\n{good}\na | b | c | d\nAnother line that says something else entirely.\nBUY NOW AND SAVE BIG!\nLast line of prose, quite ordinary."
    x = quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    assert x["kept"] and x["clean_text"] == f"{good}\nAnother line that says something else entirely.\nLast line of prose, quite ordinary."


def test_mixing(docs, rows, empty):
    from topograph.llm.mixing import draw, mix

    got = by_id(mix(docs))
    sizes, order = collections.Counter(), sorted({x[3] for x in rows}, key=lambda s: (s is None, s or ""))
    for i, t, _, s, _ in rows:
        sizes[s] += len(words(t))
        assert got[i]["size"] == len(words(t))
    weight, total, stopped = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            break
        stopped |= over
    taken = collections.Counter()
    for i, _, _, s, _ in rows:
        x = got[i]
        assert x["source_size"] == sizes[s] and math.isclose(x["target"], target[s]) and 0 <= x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    drawn = draw(docs, shards=4).collect()
    again = draw(docs.repartition(3), shards=4).collect()
    key = lambda d: sorted((x["doc_id"], x["text"] or "", x["shard"], x["pass_no"]) for x in d)
    assert key(drawn) == key(again)
    words_drawn = collections.Counter()
    for x in drawn:
        words_drawn[x["source"]] += len(words(x["text"]))
    assert words_drawn == +taken
    assert mix(empty).count() == 0 and draw(empty).count() == 0


def test_mixing_of_repeated_and_null_ids(spark):
    from topograph.llm.mixing import mix

    df = spark.createDataFrame([(None, "a b c", "x")] * 40 + [(1, "a b", "y")] * 40 + [(2, None, "z")], "doc_id long, text string, source string")
    got = mix(df).collect()
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in got) and len(got) == 81
    assert abs(sum(x["taken"] for x in got) - 200) <= 80


def test_op1_counts_what_its_shards_hold(spark, docs, empty, monkeypatch):
    from topograph.llm import mixing, queries

    repeated = spark.createDataFrame([(None, "a b c", "x")] * 40 + [(1, "a b", "y")] * 40 + [(1, "a b c", "y"), (2, None, "z"), (3, "d\ne", None)], "doc_id long, text string, source string")
    paths, write = [], mixing.write_shards
    monkeypatch.setattr(mixing, "write_shards", lambda drawn, path, shards: (write(drawn, path, shards), paths.append(path)))
    for table in (docs, repeated, empty):
        monkeypatch.setattr(queries, "table", lambda *a: table)  # noqa: B023
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        got = sorted(map(str, queries.op1_mix_sources(spark, "").collect()))
        assert got == sorted(map(str, mixing.mix(table).select(*columns).collect()))
        written = spark.read.schema("__t string, shard int").parquet(paths.pop())
        assert sum(len(words(x["__t"])) for x in written.collect()) == sum(x["taken"] for x in mixing.mix(table).collect())
    assert not paths


def test_pipeline_mixes_by_shard_in_random_order(spark, docs):
    from pyspark.sql import functions as F

    import corpus_pipeline as pipeline
    from topograph.llm.mixing import draw

    got, want = collections.defaultdict(list), collections.defaultdict(list)
    for x in pipeline.mix_sources(spark, docs, "").withColumn("at", F.spark_partition_id()).collect():
        got[x["at"]].append((x["doc_id"], x["text"]))
    for x in draw(docs, shards=4, whole=True).orderBy("shuffle_key").collect():
        want[x["shard"]].append((x["doc_id"], x["text"]))
    assert len(want) == 4 and got == want


def test_pipeline_mixes_whole_texts(spark, docs, rows):
    import corpus_pipeline as pipeline
    from topograph.llm.mixing import mix

    texts, target, drawn, longest = {x[0]: x[1] for x in rows}, {}, collections.Counter(), collections.Counter()
    for x in mix(docs).collect():
        target[x["source"]], longest[x["source"]] = x["target"], max(longest[x["source"]], x["size"])
    for x in pipeline.mix_sources(spark, docs, "").collect():
        assert x["text"] == texts[x["doc_id"]]
        drawn[x["source"]] += len(words(x["text"]))
    assert all(abs(drawn[s] - target[s]) <= longest[s] / 2 + 1 for s in target)


def test_splitting_tree_is_exact():
    from topograph.llm.mixing import splitting_tree

    quotas = np.array([0, 1, 17, 400])
    table = splitting_tree(quotas, 7)
    assert (table.sum(axis=0) == quotas).all() and (table >= 0).all()
    assert (splitting_tree(quotas, 7) == table).all()


ALPHABET = ["a", "b", "é", "à", " ", "　", " ", "  ", "\n", "\n\n", "\t", "\r\n", "<|endoftext|>", "<|startoftext|>", "'s", "1", "23", "!", "\x1c", "\x85", "́", "İ", "Σ", "漢字", "😀", "\x00", "The", "ing"]


def awkward_texts(n=4000):
    r = random.Random(2)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_bpe_is_the_librarys(docs, rows, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from topograph.llm.bpe import ForcedBoundaryBPE, byte_alphabet, encode_documents

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ForcedBoundaryBPE(path)
    for text in awkward_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text.encode())
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False)
    got = by_id(encode_documents(docs, path))
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(empty, path).count() == 0
    letters = {b: c for c, b in byte_alphabet().items()}
    piece = "".join(letters[b] for b in "hello,world(foo)bar漢字xyz".encode())
    assert "".join(own.parts(piece)) == piece and len(own.parts(piece)) > 5
    long = "".join(r.choice(ALPHABET).strip() or "z" for r in [random.Random(6)] for _ in range(30_000))
    assert np.frombuffer(own.encode(long.encode()), "<u4").tolist() == library.encode(long, add_special_tokens=False).ids


def test_token_counts_and_their_cache(docs, rows, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    from topograph.llm.token_counts import CACHE, ChunkCounter, count_tokens

    path, cache = P.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    library = Tokenizer.from_file(path)
    texts = awkward_texts()
    assert ChunkCounter(path).counts([t.encode() for t in texts]) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    stored = []
    for _ in range(2):
        got = by_id(count_tokens(docs, path, cache))
        for i, t, *_ in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
        stored.append(docs.sparkSession.read.schema(CACHE).parquet(cache).count())
    assert stored[0] == stored[1] == len({b" ".join((t or "").encode().split()) for _, t, *_ in rows})
    assert count_tokens(empty, path).count() == 0
    model = P.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    got = by_id(count_tokens(docs, model))
    assert all(got[i]["n_tokens"] == len(pieces.encode(t or "")) for i, t, *_ in rows)


def test_lm_score(docs, rows, empty):
    from topograph.llm.lm_score import fold, score

    got, counts = by_id(score(docs)), collections.Counter()
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    for i, ts in tokens.items():
        assert fold(i) == zlib.crc32(str(i).encode()) % 10
        if fold(i):
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (fold(i) == 0, len(ts), sum(counts[t] > 0 for t in ts), n)
        assert math.isclose(x["base_score"], sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
    model = interpolated(tokens, fold)
    for i, ts in tokens.items():
        assert math.isclose(got[i]["score"], model(ts), rel_tol=1e-6), i
    assert score(empty).count() == 0


def interpolated(tokens, fold):
    """The model's log10 probability of a token sequence: plain counts, EM over all tokens of the deleted documents."""

    def count(docs):
        words, pairs = collections.Counter(), collections.Counter()
        for ts in docs:
            words.update(ts)
            words["start",] += 1  # a document's start as a context
            pairs.update(zip([("start",), *ts], ts))
        return words, pairs

    bucket = lambda c: min(c.bit_length(), 23)
    train, rest = count(ts for i, ts in tokens.items() if fold(i)), count(ts for i, ts in tokens.items() if fold(i) > 1)
    size = lambda words: sum(c for w, c in words.items() if w != ("start",))
    n_types = len(train[0]) - 1
    events = collections.Counter((rest[1][u, w], rest[0][u], rest[0][w]) for i, ts in tokens.items() if fold(i) == 1 for u, w in zip([("start",), *ts], ts))
    terms = lambda w, pair, context, word, n: [w[0] * pair / context if context else 0.0, w[1] * word / n, w[2] / (n_types + 1)]
    weights = [[0.0, 0.5, 0.5]] + [[1 / 3] * 3] * 23
    for _ in range(12):
        sums = collections.defaultdict(lambda: [0.0] * 3)
        for (pair, context, word), n in events.items():
            t = terms(weights[bucket(context)], pair, context, word, size(rest[0]))
            for k in range(3):
                sums[bucket(context)][k] += n * t[k] / sum(t)
        new = [[x / sum(sums[b]) for x in sums[b]] if b in sums else weights[b] for b in range(24)]
        change = max(abs(x - y) for v, w in zip(new, weights) for x, y in zip(v, w))
        weights = new
        if change < 1e-4:
            break
    weights = [[a * (1 - 1e-6), b * (1 - 1e-6), c * (1 - 1e-6) + 1e-6] for a, b, c in weights]
    return lambda ts: sum(math.log10(sum(terms(weights[bucket(train[0][u])], train[1][u, w], train[0][u], train[0][w], size(train[0])))) for u, w in zip([("start",), *ts], ts))


def test_lm_weights_maximise_held_out_likelihood(spark):
    from topograph.llm.lm_score import BUCKETS, fit_weights

    events = spark.createDataFrame([(3, 2, 4, 10, 30), (3, 0, 5, 8, 20), (3, 0, 6, 0, 5)], "bucket int, pair long, context long, word long, n long")
    weights = fit_weights(events, (100, 50), rounds=200)
    assert len(weights) == BUCKETS and all(math.isclose(sum(w), 1) for w in weights)
    value = lambda w: sum(n * math.log(w[0] * p / c + w[1] * u / 100 + w[2] / 51) for p, c, u, n in ((2, 4, 10, 30), (0, 5, 8, 20), (0, 6, 0, 5)))
    best = value(weights[3])
    r = random.Random(0)
    for _ in range(300):
        w = [r.random() for _ in range(3)]
        assert value([x / sum(w) for x in w]) <= best + 1e-3


def test_minimum_cut_against_all_labellings():
    from topograph.llm.html_extract import minimum_cut

    r = random.Random(7)
    for _ in range(200):
        n = r.randrange(1, 9)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        cost = lambda keep: sum(max(-o, 0) if k else max(o, 0) for o, k in zip(odds, keep)) + sum(w for (i, j), w in edges.items() if keep[i] != keep[j])  # noqa: B023, E731
        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert math.isclose(cost(minimum_cut(odds, edges)), best, abs_tol=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li></ul></nav><div class="cookie-notice">We use cookies on this site. Accept them all.</div>
<!-- ad --><div class="ad">Buy this thing now, it is good.</div><article><h1>A   title &amp; more</h1><p><b>First</b> par&eacute;
graph of the article with words.<br><p>Second, unclosed paragraph of the article.<form>Name <input></form><aside>Related things to read.</aside>
<p>Short.</article><div id="comments"><p>A reader wrote a long comment about this article here.</p></div><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    from topograph.llm.html_extract import extract, main_text

    want = "A title & more First paré graph of the article with words. Second, unclosed paragraph of the article. Short."
    assert main_text(PAGE) == want
    assert main_text(None) == main_text("") == main_text("<") == ""
    assert main_text("<body><nav>x</nav><article><p>Cut off in the mid") == "Cut off in the mid"
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted((x["page_id"] or 0, x["text"], x["n_chars"]) for x in got) == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    from topograph.llm.warc import archive

    big, other = "é" * 700, "<p>" + "y" * 2000
    rows = [(i, f"http://h/{i}", big) for i in range(60)] + [(100, None, other), (101, "a\r\nb: c", other), (102, "u", None), (103, "u", ""), (104, "u", "small"), (105, "u", "small"), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = [x for x in archive(df, f"file://{tmp_path}/a").collect()]
    assert all(x["gap_start"] is None for x in got) and len(got) == len(rows)
    by = {x["page_id"]: x for x in got}
    for i, _, html in rows:
        data = (html or "").encode()
        x = by[i]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        head = {big: 59, other: 101}.get(html) if len(data) >= 1000 else None
        assert (x["record_type"], x["refers_to"]) == (("revisit", head) if head is not None and i != head else ("response", None))
    assert archive(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_warc_files_are_cut_by_bytes_and_bad_payloads_logged(spark, tmp_path, monkeypatch):
    import os

    from topograph.llm import warc

    r = random.Random(1)
    df = spark.createDataFrame([(i, "u", "%x" % r.getrandbits(20_000), "clash", True) for i in range(40)], "page_id long, url string, html string, digest string, revisit boolean").repartition(1)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    build = warc.write_warc
    build(df, f"file://{tmp_path}/a")
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "a") for f in fs if f.startswith("part-")]
    assert sum(sizes) > 100_000 and max(sizes) <= 25_000 and warc.read_warc(spark, f"file://{tmp_path}/a").filter("page_id is not null").count() == 40
    good = warc.member(warc.record(1, "u", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None, False, "2024-01-01T00:00:00Z"))
    bad = warc.member(warc.record(2, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None, False, "2024-01-01T00:00:00Z"))
    os.makedirs(tmp_path / "b")
    (tmp_path / "b" / "x.warc.gz").write_bytes(good + bad + good)
    rows = warc.read_warc(spark, f"file://{tmp_path}/b").collect()
    assert [x["page_id"] for x in rows if x["gap_start"] is None] == [1, 1]
    assert [(x["gap_start"], x["gap_end"]) for x in rows if x["gap_start"] is not None] == [(len(good), len(good) + len(bad))]


def test_token_counts_of_hot_contents(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from topograph.llm import token_counts as tc

    monkeypatch.setattr(tc, "HOT_ROWS", 3)
    df = spark.createDataFrame([(i, "hot text" if i % 2 else None if i % 3 else f"t {i}", 9) for i in range(60)], "doc_id long, text string, n_tokens long").repartition(5)
    got = {x["doc_id"]: x["n_tokens"] for x in tc.count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    few = {x["doc_id"]: x["n_tokens"] for i in (0, 1, 2, 6) for x in tc.count_tokens(df.filter(f"doc_id = {i}"), P.path("word_bpe_49k.json")).collect()}
    assert len(got) == 60 and all(got[i] == few[i] for i in few) and got[59] == got[1]


def test_warc_reader_holds_one_member_at_a_time(monkeypatch):
    """Records come as they are read, and those before damage inside a member too."""
    from topograph.llm import warc

    members = [warc.member(warc.record(i, None, b"p%d" % i * 500, hashlib.sha1(b"p%d" % i * 500).hexdigest(), None, False, "2024-01-01T00:00:00Z")) for i in range(50)]
    opened, real = [], warc._member_at
    monkeypatch.setattr(warc, "_member_at", lambda data, at: opened.append(at) or real(data, at))
    found = warc.salvaged(b"".join(members))
    assert next(found).head["page-id"] == "0" and len(opened) == 1
    assert [int(x.head["page-id"]) for x in found] == list(range(1, 50)) and len(opened) == 50
    long = warc.member(b"".join(warc.record(i, None, bytes([i]) * 4000, hashlib.sha1(bytes([i]) * 4000).hexdigest(), None, False, "2024-01-01T00:00:00Z") for i in range(30)))
    assert [x.head["page-id"] for x in warc.salvaged(long)] == [str(i) for i in range(30)]
    cut = list(warc.salvaged(long[: len(long) // 2] + b"\xff" * 20 + members[0]))
    assert isinstance(cut[-2], warc.Gap) and cut[-1].head["page-id"] == "0"
    assert 5 < len(cut) < 30 and [x.head["page-id"] for x in cut[:-2]] == [str(i) for i in range(len(cut) - 2)]


def test_warc_salvage():
    import gzip

    from topograph.llm.warc import member, record, salvage

    recs = [record(i, "u", b"payload %d " % i * 50, hashlib.sha1(b"payload %d " % i * 50).hexdigest(), None, False, "2024-01-01T00:00:00Z") for i in range(6)]
    found = lambda data: [int(h["page-id"]) for h, _ in salvage(data).records]
    for parts in ([member(x) for x in recs], recs, [gzip.compress(recs[0] + recs[1]), *map(member, recs[2:4]), *recs[4:]]):
        whole = b"".join(parts)
        assert found(whole) == list(range(6)) and not salvage(whole).gaps
        assert found(b"junk" + whole) == list(range(6)) and salvage(b"junk" + whole).gaps == [(0, 4, "no member or version line")]
    for parts in ([member(x) for x in recs], recs):
        data = bytearray(b"".join(parts))
        start, end = sum(map(len, parts[:2])), sum(map(len, parts[:3]))
        data[(start + end) // 2] ^= 0xFF
        got = salvage(bytes(data))
        assert [int(h["page-id"]) for h, _ in got.records] == [0, 1, 3, 4, 5] and [g[:2] for g in got.gaps] == [(start, end)]
        cut = b"".join(parts)[: start + 20]
        assert found(cut) == [0, 1] and salvage(cut).gaps[-1][1] == len(cut)
    wrong = record(7, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None, False, "2024-01-01T00:00:00Z")
    got = salvage(member(recs[0]) + member(wrong) + recs[1])
    assert got.places == [(0, (a := len(member(recs[0])))), (a, (b := a + len(member(wrong)))), (b, b + len(recs[1]))]
    assert member(b"x" * (1 << 24))[-1] == 0 and len(gzip.decompress(member(b"x" * (1 << 24)))) == 1 << 24


def test_pipeline(docs, empty, spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    from topograph.llm.common import materialize

    for table in (docs, empty):
        now = table
        for name, stage in pipeline.STAGES:
            out = materialize(stage(spark, now, ""), "stage")
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == table.columns
            now, before = out, now
            ids = {x["doc_id"] for x in out.select("doc_id").collect()}
            assert ids <= {x["doc_id"] for x in before.select("doc_id").collect()}
            if name == "near_dedup":
                _, roots = near_components([(x["doc_id"], x["text"]) for x in before.collect()])
                assert ids == set(roots.values())
            if name == "exact_dedup":
                texts = [re.sub(r"[\x20\x09-\x0D]", "", x["text"]) for x in before.collect()]
                assert out.count() == len(set(texts))
