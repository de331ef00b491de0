"""A phrase that every document holds in other words is spread over buckets, a passage that many hold meets in two steps, and the result stays exact."""

import collections
import hashlib

import numpy as np
import pytest

from kindred.llm import substring

PHRASE = [f"phrase{k}" for k in range(8)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    passage = [f"pass{k}" for k in range(30)]
    out = []
    for k in range(400):
        words = []
        for _ in range(12):
            words += [f"w{x}" for x in rng.integers(0, 5000, 16)] + PHRASE
        if k % 20 == 0:
            words[50:50] = passage
        out.append(words)
    return out + [out[3][20:120], out[7], ["x"] * 2000]


@pytest.fixture(scope="module")
def keyed(spark, texts):
    rows = [(k, 5, " ".join(w)) for k, w in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, mark long, text string").repartition(4)


def packed(keyed, batches=1):
    """Packed rows by the module's own lists."""
    return substring.packed(keyed, 64, substring.listed_minimisers(keyed, batches), max(1, round(batches**0.5)))


def exact(texts):
    """``(n_words, n_removed, kept_sha256)`` of each text, by brute force."""
    first, want = {}, {}
    for k, w in enumerate(texts):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (k, s))
    for k, w in enumerate(texts):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (k, s):
                gone[s : s + 20] = [True] * 20
        want[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return want


def shares(df):
    """Windows in each bucket."""
    held = collections.Counter()
    for r in df.collect():
        if r.ends is None:
            strings = substring.zstandard.ZstdDecompressor().decompress(r.strings).split(b"\n")
            held[r.bucket] += sum(s.count(b" ") + 2 - substring.WINDOW for s in strings)
    return held


def test_a_frequent_phrase_is_spread(keyed, monkeypatch):
    before = shares(packed(keyed))
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "HEAVY_BYTES", 20_000)
    heavy, crowded = substring.listed_minimisers(keyed, 1)
    assert 1 <= len(heavy) <= 20 and (heavy[:-1] < heavy[1:]).all() and set(heavy) == set(crowded)
    after = shares(packed(keyed))
    assert abs(sum(after.values()) - sum(before.values())) < 100  # what repeats in a batch doesn't travel
    assert max(before.values()) > 3 * sum(before.values()) / 64
    assert max(after.values()) < 1.5 * sum(after.values()) / 64


def test_the_result_is_exact_with_heavy_minimisers(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "HEAVY_BYTES", 20_000)
    want = exact(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 2500


def test_a_list_at_most_so_long(keyed, monkeypatch):
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "HEAVY_BYTES", 10)
    monkeypatch.setattr(substring, "HEAVY", 3)
    assert [len(x) for x in substring.listed_minimisers(keyed, 1)] == [3, 3]
    assert [len(x) for x in substring.listed_minimisers(keyed.where("false"), 1)] == [0, 0]


@pytest.fixture(scope="module")
def crowd():
    """Texts of which a third hold one passage, a third of those one word further on in it; and repeated rows."""
    rng = np.random.default_rng(4)
    passage = [f"pass{k}" for k in range(60)]
    out = []
    for k in range(900):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 30)]
        if k % 3 == 0:
            words[10:10] = passage[k // 3 % 3 :]
        out.append(words)
    return [*out, out[0], out[3], passage * 3, ["x"] * 500]


def test_a_passage_in_a_third_of_all_texts_meets_in_two_steps(spark, crowd, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # 226 batches
    try:
        docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(crowd)], "doc_id long, text string").repartition(4).cache()
        keyed = docs.select(substring.F.col("doc_id").alias("id"), substring.F.lit(5).cast("long").alias("mark"), "text")
        monkeypatch.setattr(substring, "SAMPLE", 1)
        monkeypatch.setattr(substring, "BATCH_BYTES", 1_000)
        monkeypatch.setattr(substring, "HEAVY_BYTES", 1 << 30)
        before = collections.Counter(r.bucket for r in packed(keyed, 225).collect())
        monkeypatch.setattr(substring, "HEAVY_BYTES", 8_000)
        heavy, crowded = substring.listed_minimisers(keyed, 225)
        assert len(crowded) > 1 and set(heavy) <= set(crowded)
        rows = packed(keyed, 225).collect()
        hot = collections.Counter(r.bucket for r in rows if r.bucket < 0)
        assert max(before.values()) > 150 and len(hot) > 15
        assert max(hot.values()) < 60  # 15 batches a share, on average
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs).collect()}
        assert got == exact(crowd) and sum(n for _, n, _ in got.values()) > 15_000
        twice = docs.union(docs.where("doc_id % 3 = 0"))  # of rows at one place neither is earlier
        again = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(twice).collect()}
        assert again == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
