"""Operators on documents against brute force, over a table with every awkward row."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from kindred.llm import decontam, langid, packing, quality, sharding, simhash, substring

PASSAGE = " ".join(f"pass{k}" for k in range(45))
PROSE = " ".join(f"word{(k * k) % 97}" for k in range(300))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " + PASSAGE + " omega"),
    (2, "Some other opening, then " + PASSAGE + " and an end"),
    (3, "Some other opening, then " + PASSAGE + " and an end"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "one"),
    (8, "one two"),
    (9, "x " * 3000),
    (10, PROSE + "\n" + PASSAGE + "\n" + PASSAGE),
    (10, PROSE + "\n" + PASSAGE + "\n" + PASSAGE),
    (11, PROSE.replace("word9", "WORD9")),
    (12, "Ärger über Öl ist groß\x0bund\x0c rund"),
    (13, PROSE + " tail"),
    (None, "no id but " + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, i, "row") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, fp string").repartition(3)


def rank(i):
    return -(1 << 63) if i is None else i


def test_substring_equals_brute_force(docs):
    words = [(rank(i), (t or "").encode().split()) for i, t in ROWS]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    want = collections.Counter()
    for (i, _), (r, w) in zip(ROWS, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (r, s):
                gone[s : s + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(map(tuple, substring.substring_dedup(docs).collect())) == want


def test_windows_with_equal_sums_are_told_apart():
    strings = [b" ".join(b"a%d" % (k % 7) for k in range(60)), b" ".join(b"a%d" % (k % 7) for k in range(30))]
    found = substring.repeated_windows(strings, np.array([5, 3]), np.array([0, 0]), np.array([0, 10]))
    covered = {(i, p) for i, _, a, b in found.tolist() for p in range(a, b)}
    assert {p for i, p in covered if i == 5} == set(range(60))
    assert {p for i, p in covered if i == 3} == set(range(17, 40))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs):
    fps = [(i, brute_fingerprint(t)) for i, t in ROWS]
    parent = list(range(len(fps)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(fps):
        groups[find(k)].append(i)
    want = collections.Counter((i, f"{f:016x}", min((x for x in groups[find(k)] if x is not None), default=None)) for k, (i, f) in enumerate(fps))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_links_through_a_chain_and_split_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40)
    fps = {int(b) for b in base}
    for b in base[:8].tolist():
        for _ in range(12):
            b ^= (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63)))
            fps.add(b)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, block=2, visitors=3).collect()
    found = simhash.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    got = {r.node: r.root for r in found.collect()}
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert all(got.get(f, f) == label[f] for f in fps)


def test_representatives_keep_one_of_each_group(docs):
    made = [simhash.wide_fingerprint(t and t.encode()) for _, t in ROWS]
    band = [int(np.floor(np.log(max(n, 1)) / np.log(simhash.LENGTH_RATIO))) for _, n in made]
    label = list(range(len(ROWS)))
    for _ in ROWS:
        for a, (x, _) in enumerate(made):
            for b, (y, _) in enumerate(made):
                apart = (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()
                if apart <= simhash.WIDE_RADIUS and abs(band[a] - band[b]) <= 1:
                    label[a] = label[b] = min(label[a], label[b])
    assert {label[1], label[2]} == {label[2]} and label[11] == label[13] != label[8]
    want = sorted(min((i for k, (i, _) in enumerate(ROWS) if label[k] == g and i is not None), default=None) for g in set(label))
    kept = simhash.representatives(docs)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert kept.columns == docs.columns


def test_quality_measures(docs):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    want = collections.Counter()
    for i, t in ROWS:
        w = (t or "").encode().split()
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = [False] * len(w)
        for k in range(len(w) - 7):
            if count[tuple(w[k : k + 8])] > 1:
                hit[k : k + 8] = [True] * 8
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        failed = len(w) < 20 or 100 * sum(hit) > 30 * len(w)
        want[(i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(hit), failed)] += 1
    assert got == want


def test_label_model_finds_the_planted_labels():
    rng = np.random.default_rng(1)
    good = rng.random(5000) < 0.8
    votes = np.zeros((5000, 6), int)
    for k in range(6):
        right = rng.random(5000) < 0.85
        votes[:, k] = np.where(rng.random(5000) < 0.2, 0, np.where(right == good, 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.93
    assert abs(model.prior - 0.8) < 0.05


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose = [" ".join(f"{w}{(k * j) % 89}" for j, w in enumerate(["the", "river", "ran", "past", "houses"] * 14)) for k in range(1, 60)]
    junk = [" ".join(f"{w}###" for w in p.split()) for p in prose[:5]] + [" ".join(w.upper() + "!!" for w in p.split()) for p in prose[5:9]]
    rows = [(k, t) for k, t in enumerate(prose + junk)]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(len(prose)))


def test_shards(docs):
    got = sharding.shards(docs, 4).orderBy("shard", "slot").collect()
    assert len(got) == len(ROWS)
    want = sorted(((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in ROWS), key=lambda r: (r[0] is not None, rank(r[0])))
    assert [r[0] for r in want] == [r.doc_id for r in got]
    assert collections.Counter(want) == collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(4):
        rows = [r for r in got if r.shard == s]
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 4) <= most


def test_packing(docs):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, tokenizer, length=64, open_windows=3).collect()
    whole = Tokenizer.from_file(tokenizer)
    want = collections.Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in ROWS)
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for (i, ids), n in want.items():
        assert sum(r.length for r in pieces[i]) == n * len(ids)
        assert {(r.start, r.ids_crc32) for r in pieces[i]} == {(s, zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for s in range(0, len(ids), 64)}
    tokens = sum(r.length for r in got)
    assert tokens / (64 * len(sequences)) > 0.85


def test_word_ids_are_the_texts_ids():
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    alphabet = list("abcdeXYZ'st 01.,!-#\t\n\x0b\x0c\r<|>éÜßñ漢字́ ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "  ", "'re", "ªµÉ", "İ", "Ꙗ", "１"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(400)]
    whole = Tokenizer.from_file(tokenizer)
    known = packing.WordIds(tokenizer)
    assert known.direct
    got = [known.of(t.encode(), np.array([2], "<u4").tobytes()) for t in texts]
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_leaks_equal_brute_force(spark, docs):
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[:30]).upper()), (3, "never seen " * 9), (4, "one two"), (5, None), (6, " ".join(PASSAGE.split()[2:44]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}

    def counts(w):
        return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w)

    want = set()
    for i, t in ROWS:
        w = (t or "").lower().replace(",", "").split()
        for item, text in items:
            own = (text or "").lower().split()
            if own:  # of fewer than five words, one shingle as a whole
                for s in range(max(1, len(w) - len(own) + 1)):
                    a, b = counts(w[s : s + len(own)]), counts(own)
                    if a and sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                        want.add((i, item))
    assert got == want
    clean = [r.doc_id for r in decontam.clean(docs, bench).collect()]
    assert collections.Counter(clean) == collections.Counter(i for i, _ in ROWS if i not in {d for d, _ in want})


def test_weighted_similarity_counts_repeats(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), (["a"], ["a"]), (["a"], ["c"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(decontam.similarity("a", "b")).collect()] == [0.5, 1.0, 0.0]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs.select("doc_id", "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_awkward_rows(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {4, 5, 6}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


@pytest.mark.parametrize("operator", [substring.substring_dedup, simhash.near_duplicates, simhash.representatives, quality.quality, sharding.shards, langid.identify, lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: decontam.leaks(d, d.select(d.doc_id.alias("item_id"), "text"))])
def test_empty_table(docs, operator):
    assert operator(docs.where("false")).collect() == []
