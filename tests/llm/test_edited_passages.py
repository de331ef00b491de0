"""Edited, truncated and moved passages of a benchmark against brute force over all windows."""

import collections

import numpy as np
import pytest

from kindred.llm import decontam


def counts(w):
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def best(w, own):
    top = 0.0
    for s in range(-len(own) + 5, len(w) - 4):
        a, b = counts(w[max(s, 0) : s + len(own)]), counts(own)
        top = max(top, sum((a & b).values()) / sum((a | b).values()) if a else 0.0)
    return top


def corpus(kind):
    rng = np.random.default_rng(21)

    def prose(n):
        return [f"w{k}" for k in rng.integers(0, 20_000, n)]

    items, docs = [], []
    for n, cut in [(60, 6), (40, 4), (100, 10), (22, 2), (30, 2), (15, 1)] * 15:
        own = prose(n)
        made = {
            "ends": [own[: n - cut], own[cut:], own[: n - cut - 4]],
            "moved": [own[n // 2 :] + own[: n // 2], own[n - cut :] + own[: n - cut], own[: n // 3] + own[n // 3 + 2 :]],
            "repeats": [own[:10] + own[:10] + own[10:], own[5 : n - 2] + own[:3]],
        }[kind]
        items.append(own)
        docs += [prose(int(rng.integers(0, 40))) + m + prose(int(rng.integers(0, 40))) for m in made]
    if kind == "repeats":
        items.append(["a", "b", "a", "b", "a", "b"] * 4)
        docs += [["b", "a"] * 9 + prose(9), ["a", "b"] * 40]
    return docs, items


@pytest.mark.parametrize("kind", ["ends", "moved", "repeats"])
def test_every_window_of_the_similarity_is_found(spark, kind):
    docs, items = corpus(kind)
    ours = [counts(own).keys() for own in items]
    want = {(d, i): round(s, 6) for d, w in enumerate(docs) for i, own in enumerate(items) if counts(w).keys() & ours[i] and (s := best(w, own)) >= 0.8 - 1e-9}
    rows = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert len(want) > len(items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontam.leaks(rows, bench).collect()} == want


def test_items_under_a_shingle_match_their_very_words(spark):
    items = [["one"], ["two", "words"], ["a", "b", "a", "b"], ["five", "words", "make", "a", "shingle"], [], None, ["two", "words"]]
    docs = ["x One y", "two", "words two words", "two; WORDS!", "a b a", "b a b a b a", "five words make a", "x five words make a shingle", "", None, "ones twos"]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)] + [(0, docs[0], 1)], "doc_id long, text string, hash int")
    bench = spark.createDataFrame([(k, None if w is None else " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.n_words, r.distance, r.similarity) for r in decontam.leaks(rows, bench).collect())
    assert got == [(0, 0, 1, 1, 0, 1.0), (2, 1, 1, 2, 0, 1.0), (2, 6, 1, 2, 0, 1.0), (3, 1, 0, 2, 0, 1.0), (3, 6, 0, 2, 0, 1.0), (5, 2, 1, 4, 0, 1.0), (7, 3, 1, 5, 0, 1.0)]
    assert sorted(r.doc_id for r in decontam.clean(rows, bench).collect()) == [1, 4, 6, 8, 9, 10]
