"""The block join of decontamination: every pair within the radius, few others, and tables with awkward columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import decontam


def test_counters_equal_bit_by_bit_counts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([([f"w{x}" for x in rng.integers(0, 30, n)],) for n in (1, 2, 5, 6, 64, 301)], "w array<string>").coalesce(1)
    quick = [r[0] for r in rows.select(decontam.simhash("w", 1)).collect()]
    monkeypatch.setattr(decontam, "COUNTED", 0)
    assert quick == [r[0] for r in rows.select(decontam.simhash("w", 1)).collect()]
    by_hand = rows.select("w", F.transform("w", lambda w: F.xxhash64(w, F.lit(1))).alias("h")).collect()
    for fp, r in zip(quick, by_hand, strict=True):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert fp & (1 << 64) - 1 == want


def test_blocks_cover_the_fingerprint(spark):
    assert [sum(w) for w in decontam.BLOCKS] == [64, 64] and sum(map(len, decontam.BLOCKS)) == decontam.RADIUS + 1
    low, high = 0x0123456789ABCDEF, -0x0123456789ABCDEF
    keys = spark.range(1).select(decontam.block_keys(F.lit(low), F.lit(high))).first()[0]
    rebuilt, at = [0, 0], 0
    for half, widths in enumerate(decontam.BLOCKS):
        place = 0
        for w in widths:
            rebuilt[half] |= (keys[at] - 16 * at) << place
            place, at = place + w, at + 1
    assert rebuilt == [low, high & (1 << 64) - 1]


def test_block_join_finds_all_pairs_within_the_radius_and_few_others(spark):
    rng = np.random.default_rng(5)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 3000, n)]

    items = [prose(int(n)) for n in rng.integers(20, 80, 200)]
    windows = [prose(int(n)) for n in rng.integers(20, 80, 1200)]
    for own in items:  # edited copies of each item, of its size
        for share in (0, 0.05, 0.11, 0.3):
            windows.append([w if rng.random() >= share else "new" for w in own])
    known = decontam.items(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    made = spark.createDataFrame([(k, 0, 0, len(w), w) for k, w in enumerate(windows)], "doc_id long, mark long, at int, length int, w array<string>")
    made = made.select("doc_id", "mark", "at", "length", decontam.simhash("w", 1).alias("low"), decontam.simhash("w", 2).alias("high"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.candidates(made, known).collect()}
    assert decontam.candidates(made, known).count() == len(got)
    prints = {r.doc_id: (r.low, r.high) for r in made.collect()}
    want = {}
    for r in known.collect():
        for k, w in enumerate(windows):
            apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[k], (r.item_low, r.item_high), strict=True))
            if len(w) == len(r.item_words) and apart <= decontam.RADIUS:
                want[(k, r.item_id)] = apart
    assert got == want and len(want) >= 2 * len(items)
    assert len(got) < 0.01 * len(windows) * len(items)


@pytest.fixture
def odd(spark):
    names = "doc_id long, text string, row int, mark string, gone_id int, gone_mark int, words string, item_id int, at int, id int"
    leak = " ".join(f"leak{k}" for k in range(30))
    rows = [(1, "some words before " + leak), (2, "nothing here but words of its own and a few more"), (3, None), (4, ""), (5, "long " * 60_000 + leak), (6, "word " * 100_000), (None, leak), (1, "some words before " + leak)]
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "w", 4, 5, 6) for i, t in rows], names), spark.createDataFrame([(7, leak, "z")], "item_id long, text string, doc_id string")


def test_clean_with_clashing_columns_and_long_texts(spark, odd):
    docs, bench = odd
    assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontam.leaks(docs, bench).collect()} == {(1, 7, 1.0), (5, 7, 1.0), (None, 7, 1.0)}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontam.clean(docs, bench.where("false")).count() == 8
    assert decontam.leaks(docs, bench.where("false")).collect() == []


def test_no_python_on_the_way(odd):
    docs, bench = odd
    plan = decontam.clean(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
