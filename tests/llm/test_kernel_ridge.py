"""Language identification against a kernel ridge written out from its definition, and its sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import langid


def ngrams(text):
    """The distinct 1- to 3-grams of a text's classes, runs of other characters as one."""
    classes = [0]
    for byte in text + b"\0":
        c = langid.TABLE[byte]
        if c or classes[-1]:
            classes.append(c)
    return {tuple(classes[i : i + n]) for n in (1, 2, 3) for i in range(len(classes) - n + 1)}


def ridge_by_definition(train, names, test, landmarks, ridge):
    """Values of each test text for each language, by sets and kernels, without any feature matrix."""
    order = sorted(set(names))
    chosen = [i for name in order for i in [k for k, x in enumerate(names) if x == name][:landmarks]]

    def kernel(a, b):
        a, b = ngrams(a), ngrams(b)
        return len(a & b) / (max(1, len(a)) * max(1, len(b))) ** 0.5

    among = np.array([[kernel(train[i], train[j]) for j in chosen] for i in chosen])
    values, vectors = np.linalg.eigh(among)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    mapped = np.array([[kernel(t, train[j]) for j in chosen] for t in train]) @ root
    weigh = np.diag([len(names) / len(order) / names.count(x) for x in names])
    out = []
    for name in order:
        target = np.array([1.0 if x == name else -1.0 for x in names])
        alpha = np.linalg.solve(mapped.T @ weigh @ mapped + ridge * len(names) / len(chosen) * np.eye(len(chosen)), mapped.T @ weigh @ target)
        out.append(np.array([[kernel(t, train[j]) for j in chosen] for t in test]) @ root @ alpha)
    return np.array(out).T


TEXTS = {
    "de": ["Der Fluss trat über die Ufer", "Wir gehen heute nicht", "Ein grüner Apfel, zwei Birnen", "Schöne Straße"],
    "en": ["The river ran past houses", "We shall not go today", "A green apple and two pears", "this is the thing", "three"],
    "fr": ["La rivière a débordé hier", "Nous n'irons pas ce soir", "Une pomme verte et deux poires"],
}


def test_values_equal_the_definition():
    train, names = zip(*[(t.encode(), name) for name, texts in TEXTS.items() for t in texts], strict=True)
    test = [t.encode() for t in ("Das ist eine Straße", "the green river", "la pomme de terre", "漢字", "1 2 3 a", "x")]
    for landmarks in (2, 3):
        model = langid.KernelRidge.fit(list(train), list(names), landmarks=landmarks)
        want = ridge_by_definition(list(train), list(names), test, landmarks, 1e-2)
        assert np.allclose(model.decide(test), want, atol=1e-3)


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.when(F.col("id") % 7 == 0, "b").when(F.col("id") % 7 < 6, "a").alias("lang"))
    return rows.withColumns({"place": F.lit("x"), "rank": F.lit(1), "count": F.lit(2)}).repartition(7)


def test_sample_is_the_least_hashes_of_each_language(spark, many, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid.KernelRidge, "fit", classmethod(lambda cls, texts, names, **options: seen.update(zip(texts, names, strict=True))))
    langid.fit(many.unionByName(many.where("doc_id % 5 = 0")), a_language=50)
    keyed = many.where(~langid.held_out() & F.col("lang").isNotNull()).select("text", "lang", F.shiftrightunsigned(F.xxhash64("doc_id", F.length("text")), 11).alias("h")).collect()
    for name in "ab":
        want = [r.text.encode() for r in sorted((r for r in keyed if r.lang == name), key=lambda r: r.h)[:50]]
        assert set(want) == {t for t, x in seen.items() if x == name}


def test_long_texts_and_ties(spark, many):
    odd = spark.createDataFrame([(1, "the " * 300_000, "a"), (2, "?", "b"), (2, "?", "b"), (None, "", None)], "doc_id long, text string, lang string")
    rows = langid.identify(many.select("doc_id", "text", "lang").unionByName(odd)).where("doc_id is null or doc_id in (1, 2)").collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(r.lang_pred for r in rows if r.doc_id is None) == ["und"]


def test_bytes_above_127_are_kept_apart():
    assert len({langid.TABLE[b] for b in range(128, 256)} | {langid.TABLE[b] for b in b"abcdefghijklmnopqrstuvwxyz "}) == 155
    assert max(langid.TABLE) < langid.CLASSES


def test_more_languages_than_the_bound_are_an_error(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    with pytest.raises(ValueError, match="most_languages = 299"):
        langid.fit(rows, most_languages=299)
    model = langid.fit(rows, a_language=1, landmarks=1)
    assert len(model.languages) == 300
