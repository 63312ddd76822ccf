"""Equality is that of words, not of hashes; identifiers of any sign, repeated and null ones, in any partitioning."""

import collections
import hashlib
import random

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def thue_morse(n=4096):
    """A string over {a, b} and its complement: equal under any polynomial hash modulo a power of two."""
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


@pytest.fixture
def twins(spark):
    a, b = thue_morse()
    tail = " ".join(f"t{i}" for i in range(40))
    texts = {1: " ".join(a), 2: " ".join(b), 3: f"{a} {tail}", 4: f"{b} " + " ".join(f"u{i}" for i in range(40)), 5: f"{a}\n{b}", 6: " ".join([b] + [f"v{i}" for i in range(19)]), 7: " ".join([a] + [f"v{i}" for i in range(19)])}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def by_id(df):
    return {x["doc_id"]: x for x in df.collect()}


def removed(rows, k=20):
    """doc_id -> words removed, for rows of distinct identifiers in their order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w, gone = (text or "").split(), set()
        for s in range(len(w) - k + 1):
            if tuple(w[s : s + k]) in seen:
                gone |= set(range(s, s + k))
            seen.add(tuple(w[s : s + k]))
        out[i] = len(gone)
    return out


def test_near_dedup_of_texts_that_simple_hashes_confuse(twins):
    from topograph.llm.near_dedup import near_dedup

    texts, df = twins
    got = by_id(near_dedup(df))
    sets = {}
    for i, text in texts.items():
        w = text.translate(LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    assert {i: x["n_shingles"] for i, x in got.items()} == {i: len(s) for i, s in sets.items()}
    up = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[b] = min(up[b], up[a])
    assert {i: x["component_id"] for i, x in got.items()} == up


def test_substring_dedup_of_texts_that_simple_hashes_confuse(twins):
    from topograph.llm.substring_dedup import substring_dedup

    texts, df = twins
    assert {i: x["n_removed"] for i, x in by_id(substring_dedup(df)).items()} == removed(texts.items())


def test_quality_and_scores_of_texts_that_simple_hashes_confuse(spark, twins):
    from topograph.llm.lm_score import score
    from topograph.llm.quality import quality

    texts, df = twins
    got = by_id(quality(df))
    assert got[5]["n_dup_lines"] == 0
    w = texts[1].split()
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    assert got[1]["n_repeat_words"] == len({i + o for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for o in range(5)})
    a, b = thue_morse()
    scores = by_id(score(spark.createDataFrame([(1, a), (2, f"{a} {a}"), (3, b)], "doc_id long, text string")))
    assert scores[3]["base_score"] < scores[1]["base_score"]


@pytest.mark.parametrize("weak", [False, True])
def test_substring_dedup_in_any_partitioning(spark, weak):
    """Negative identifiers come first. With hashes of one byte nearly every answer of the index is wrong: no word may go that no copy confirms."""
    from topograph.llm.substring_dedup import substring_dedup

    r = random.Random(4)
    say = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    passage = say(60)
    ids = [-5, 3, -(1 << 63), (1 << 62), 0, -1, 7, 8, 9]
    rows = [(i, f"{say(r.randrange(0, 80))} {passage if i % 2 else say(30)} {say(10)}") for i in ids] + [(20, passage), (-20, passage), (21, None), (22, "")]
    want, df = removed(rows), spark.createDataFrame(rows, "doc_id long, text string")
    assert want[-20] == 0 and want[20] == 60
    for n in (1, 7):
        got = {i: x["n_removed"] for i, x in by_id(substring_dedup(df.repartition(n), bits=8 if weak else 64)).items()}
        assert all(got[i] <= want[i] for i in want) and sum(got.values()) > 0 if weak else got == want


def test_repeated_and_null_identifiers(spark):
    from topograph.llm.lm_score import score
    from topograph.llm.quality import quality
    from topograph.llm.substring_dedup import substring_dedup

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "a b"), (2, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x["doc_id"], x["n_words"], x["n_removed"]) for x in substring_dedup(df).collect()]
    assert collections.Counter(got) == collections.Counter({(1, 30, 0): 1, (1, 30, 30): 1, (None, 30, 30): 1, (None, 0, 0): 1, (2, 2, 0): 2})
    assert sorted(x["n_tokens"] for x in score(df).collect()) == [1, 3, 3, 31, 31, 31]
    assert sorted(x["n_words"] for x in quality(df).collect()) == [0, 2, 2, 30, 30, 30]
    with pytest.raises(TypeError):
        substring_dedup(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_token_operators_with_repeated_and_null_identifiers(spark):
    P = pytest.importorskip("public_tokenizers")
    from topograph.llm.bpe import encode_documents
    from topograph.llm.token_counts import count_tokens

    df = spark.createDataFrame([(1, "a b")] * 3 + [(None, "a b"), (None, None), (-1, "")], "doc_id long, text string").repartition(3)
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted((x["doc_id"] or 0, x["n_tokens"], x["decoded_sha256"] == empty) for x in encode_documents(df, P.path("byte_bpe_50k.json")).collect())
    assert got == [(-1, 0, True), (0, 0, True), (0, 2, False), (1, 2, False), (1, 2, False), (1, 2, False)]
    assert len(count_tokens(df, P.path("word_bpe_49k.json")).collect()) == 6
