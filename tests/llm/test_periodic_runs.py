"""Periodic runs against a plain search, in one range of lags and in many."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from kindred.llm import periodic, queries


def brute(words):
    """``(start, period, length)`` of all runs, lag by lag and word by word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, m) for (s, m), q in found.items())


def collapse(words, runs):
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tailed(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(words):
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1])) if runs else None
    figures = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in runs)
    return (len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"][: 1 + seed % 3 + (seed > 2)]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            unit = words[: rng.randint(1, 7)]
            words = words + unit * rng.randint(0, 9) + words[::-1]
        assert periodic.runs_of(words) == brute(words)
        assert b" ".join(periodic.kept(words, periodic.runs_of(words))).decode() == collapse([w.decode() for w in words], brute(words))


def test_blocks_and_ranges_of_lags_change_nothing(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b"]) for _ in range(200)] + [b"x", b"y", b"z"] * 40
    want = brute(words)
    ids = periodic.word_ids(words)
    for cells in (1, 1000, 1 << 20):
        monkeypatch.setattr(periodic, "CELLS", cells)
        merged = {}
        for first in range(1, len(words), 7):
            for k, q in periodic.scan(ids, first, first + 6).items():
                merged[k] = min(q, merged.get(k, q))
        assert sorted((s, q, m) for (s, m), q in merged.items()) == want


def test_many_different_words():
    words = [b"%d" % k for k in range(70_000)]
    ids = periodic.word_ids(words)
    assert ids.dtype.itemsize == 4 and periodic.scan(ids, 1, 3) == {}
    assert periodic.scan(periodic.word_ids([*words[:100], *[b"r"] * 7]), 1, 3) == {(100, 7): 1}


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    long = 0
    for r in docs:
        words = tailed(r.doc_id, r.text)
        if len(words) > 3000:
            long += 1
            if long > 4:
                continue
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == expected(words), r.doc_id
    assert long and sum(r.n_runs > 0 for r in got.values()) > 50


def test_awkward_rows_short_and_long(spark, monkeypatch):
    """Long texts are cut into ranges of lags; copies of one share the scan."""
    phrase = " ".join(f"w{k}" for k in range(500))
    texts = ["", None, "a", "a a a a a a", "a\ta\na a a b", "é ü é ü é ü é ü x", " ".join([phrase] * 5), "x " * 9000, " ".join(f"v{k % 2900}" for k in range(12_000)), "z" * 40_000]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(6, texts[6], 1, "x"), (None, texts[6], 1, "x"), (77, texts[7], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, key string")
    got = periodic.collapsed(df).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r.row.text or "").split()
        found = [(x.start, x.period, x.length) for x in r.runs]
        if r.row.doc_id == 8:
            assert found == [(0, 2900, 12_000)]
        elif r.row.doc_id in (7, 77):
            assert found == [(0, 1, 9000)] and r.kept_text == "x"
        else:
            assert found == brute(words)
        assert r.n_words == len(words) and r.kept_text == collapse(words, found)
    assert periodic.digest(periodic.collapsed(df.limit(0))).count() == 0


def test_tails(spark):
    text = "one two\tthree  four five six seven eight nine ten"
    df = spark.createDataFrame([(k, text) for k in range(200)] + [(None, text), (0, None), (3, " ")], "doc_id long, text string")
    rows = periodic.with_tails(df).collect()
    for r in rows:
        if r.doc_id is not None and r.text not in (None, " "):
            assert r.text.split() == tailed(r.doc_id, text)
    assert sum(r.text != text for r in rows) > 10 and len(rows) == 203
