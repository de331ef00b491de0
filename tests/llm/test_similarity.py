"""Near-duplicates against the similarity of five-word shingles itself, not against fingerprints."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from kindred.llm import simhash


def similarity(a, b):
    a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w) for w in ((t or "").lower().split() for t in (a, b)))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def texts():
    rng = np.random.default_rng(8)

    def prose(n):
        return [f"w{k}" for k in rng.integers(0, 5000, n)]

    def edited(words, n):
        words = list(words)
        for k in rng.choice(len(words), n, replace=False):
            words[k] = f"edit{rng.integers(10**6)}"
        return words

    line = prose(12)
    out = []
    # One line 26 times among wholly different words: a fingerprint of weights hardly sees these.
    for _ in range(8):
        body = prose(800)
        out.append([w for k in range(26) for w in [*body[k * 30 : k * 30 + 30], *line]] + body[780:])
    for n, cut in [(400, 8), (400, 16), (400, 24), (100, 2), (100, 3), (60, 1), (60, 2), (30, 1), (14, 0), (9, 0)] * 6:
        base = prose(n)
        out += [base, edited(base, cut), base[: n - max(1, n // 12)]]
    # A chain whose ends are far apart, and one text in which much is repeated and its like without the repeats.
    chain = prose(300)
    out += [chain[k * 12 : 200 + k * 12] for k in range(8)]
    often = prose(80)
    out += [often + ["again"] * 24, often + ["again"] * 2]
    return [" ".join(w) for w in out] + ["", None, "One two", "one  TWO"]


def groups(texts):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and (similarity(texts[a], texts[b]) >= 0.8 or not (texts[a] or texts[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("block", [4096, 3])
def test_stage_keeps_one_of_each_group_by_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "TEXTS_A_BLOCK", block)
    found = texts()
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in enumerate(found)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert got == sorted(set(groups(found)))


def test_repeats_are_elements_of_their_own():
    a, b = (simhash.shingle_set(t.encode()) for t in ("a " * 30 + "b", "a " * 20 + "b"))
    shared = len(np.intersect1d(a, b))
    assert (len(a), len(b), shared) == (27, 17, 17)
    assert len(simhash.shingle_set(b" ")) == len(simhash.shingle_set(None)) == 0


@pytest.mark.parametrize("n", [9, 40, 400, 20_000])
def test_similar_sets_share_a_key(n):
    """At a similarity of just 0.8, whatever the size, all but one pair in ten thousand share a key; at 0.2 few do."""
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 2**64, 2 * n, np.uint64)) for _ in range(200)]
    extra = n // 9

    def share(part):
        hits = 0
        for x in sets:
            x = rng.permutation(x)
            common, a, b = x[: n - part], x[n - part : n], x[n : n + part]
            hits += bool(np.any(simhash.minima(np.sort(np.append(common, a))) == simhash.minima(np.sort(np.append(common, b)))))
        return hits

    assert share(extra) >= 199
    assert share(2 * n // 3) <= 8


@pytest.mark.parametrize("segments", [4, 8])
def test_tiles_of_any_number_of_segments_join_the_same_fingerprints(spark, segments):
    rng = np.random.default_rng(12)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63, 400)}
    for x in sorted(fps)[:60]:
        for _ in range(4):
            x ^= (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63)))
            fps.add(x)
    fps = sorted(fps | {0, -1, 1, 3, 7})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, block=3, visitors=5, segments=segments).collect()
    got = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {f: f for f in fps}
    for _ in range(8):
        for a in fps:
            for b in fps:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(f, f) == label[f] for f in fps)


@pytest.mark.parametrize("size", [15, 40, 200])
def test_recall_by_similarity(spark, size):
    """Planted pairs of each similarity from 0.8 to 1: none is missed among 240 a step."""
    rng, pairs = np.random.default_rng(size), []
    for step in np.arange(0.80, 1.0001, 0.05):
        for _ in range(240):
            base = [f"w{k}" for k in rng.integers(0, 50_000, size)]
            # Without its last m of n shingles a text has a similarity of 1 - m / n.
            m = int((1 - step) * (size - 4) + 1e-9)
            pairs.append((base, base[: size - m]))
    rows = [(2 * k + j, " ".join(x)) for k, pair in enumerate(pairs) for j, x in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.representatives(docs, least=simhash.SIMILARITY).select("doc_id").collect()}
    missed = [k for k in range(len(pairs)) if 2 * k + 1 in kept]
    assert all(2 * k in kept for k in range(len(pairs)))
    assert len(missed) <= len(pairs) // 1000, [similarity(*map(" ".join, pairs[k])) for k in missed]
