"""The pipeline's rows against a brute-force version of its five stages."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from kindred.llm import quality
from kindred.sources import shared


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(800)]

    def prose(n):
        words = rng.choice(vocabulary, n).tolist()
        return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, n, 12)) + ".\nEnd here."

    texts = [prose(int(n)) for n in rng.integers(40, 300, 24)]
    passage, leak = prose(60), prose(30)
    texts += [texts[0], texts[1].replace(".", " .", 1), " ".join([*texts[2].split()[:-1], "changed"])]
    texts += [prose(50) + "\n" + passage + "\n" + prose(40) for _ in range(3)]
    texts += [prose(60) + "\n" + leak + "\n" + prose(30), prose(80) + " " + leak]
    # Too short to match a shingle of the benchmark, but its last item word for word.
    texts += [prose(90) + " xylo phone"]
    texts += [" ".join(w + "###" for w in prose(60).split()), " ".join(w.upper() + "!!" for w in prose(60).split()), "too short", None, ""]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[5]], [(1, leak), (2, prose(25)), (3, None), (4, "Xylo, phone")]


def shingles(text):
    words = text.lower().split()
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)) if words)


def one_of_each(docs):
    """Groups by the similarity of five-word shingles with repeats, all pairs compared."""
    made, label = {k: shingles(t) for k, t in docs.items()}, {k: k for k in docs}
    for a in docs:
        for b in docs:
            x, y = made[a], made[b]
            if label[a] != label[b] and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return {k: t for k, t in docs.items() if label[k] == k}


def without_repeats(docs):
    first, out = {}, {}
    words = {k: t.split() for k, t in sorted(docs.items())}
    for k, w in words.items():
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (k, s))
    for k, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (k, s):
                gone[s : s + 20] = [True] * 20
        out[k] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def leaked(text, items):
    def words(t):
        return "".join(c if c.isalnum() else " " for c in t.lower()).split()

    def counts(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)

    w = words(text)
    for _, item in items:
        own = words(item or "")
        for s in range(max(1, len(w) - len(own) + 1) if own else 0):
            a, b = counts(w[s : s + len(own)]), counts(own)
            if a and sum((a & b).values()) / sum((a | b).values()) >= 0.8:
                return True
    return False


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_rows_equal_brute_force(spark, folder):
    rows, items = corpus()
    kept = {r.doc_id for r in quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").collect()}
    texts = {k: t for k, t, *_ in rows if k in kept}
    assert {33, 34, 35, 36, 37}.isdisjoint(kept) and 32 in kept and set(range(24)) <= kept
    texts = without_repeats(one_of_each(texts))
    texts = {k: t for k, t in texts.items() if not leaked(t, items)}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, t in texts.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        want |= {(k, s): (len(ids), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)}
    got = {(r.doc_id, r.start): (r.doc_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), folder).collect() == []
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def owned_tables(spark):
    return {path for (app, _), paths in shared.TABLES.items() if app == spark.sparkContext.applicationId for path in paths}


def test_results_of_other_calls_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = corpus_pipeline.keep_quality(spark, docs, folder)
    b = corpus_pipeline.keep_one_of_each(spark, docs, folder)
    c = corpus_pipeline.drop_leaks(spark, a, folder)  # not written in between
    n = a.count()
    assert n and b.count() and 0 < c.count() < n


def test_a_written_copy_uses_a_result_up(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = owned_tables(spark)
    corpus_pipeline.keep_quality(spark, docs, folder).write.parquet(str(tmp_path / "a"))
    mine = owned_tables(spark) - before
    other = corpus_pipeline.keep_quality(spark, docs, folder)
    theirs = owned_tables(spark) - before - mine
    assert mine and theirs
    corpus_pipeline.keep_one_of_each(spark, spark.read.parquet(str(tmp_path / "a")), folder).count()
    assert mine.isdisjoint(owned_tables(spark)) and theirs <= owned_tables(spark)
    assert other.count()


def test_null_and_repeated_ids_through_all_stages(spark, tmp_path):
    rows, items = corpus()
    odd = [(None, *rows[3][1:]), (None, *rows[7][1:]), (None, None, None, None, None), (rows[4][0], *rows[6][1:]), rows[9], (900, "w" * 300_000, "en", "s", 1)]
    spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    starts = collections.Counter((r.doc_id, r.start) for r in got)
    assert starts[rows[4][0], 0] == 2 and starts[3, 0] == 1 and starts[9, 0] == 1  # two texts of one id; copies once
