"""The posterior decides: against a brute-force expectation-maximisation, against labels, and against all-must-pass."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import quality


def brute_force(votes, counts, rounds=100, belief=20.0):
    """The posterior of each pattern, by loops over patterns, rules and votes."""
    before = {0: {-1: 0.35, 0: 0.25, 1: 0.40}, 1: {-1: 0.05, 0: 0.15, 1: 0.80}}
    rules = range(len(votes[0]))
    rates, prior = {y: [dict(before[y]) for _ in rules] for y in (0, 1)}, 0.8

    def posterior(pattern):
        p = {1: prior, 0: 1 - prior}
        for y in (0, 1):
            for r in rules:
                p[y] *= rates[y][r][pattern[r]]
        return p[1] / (p[0] + p[1])

    for _ in range(rounds):
        good = [posterior(v) for v in votes]
        mass = {y: [c * (g if y else 1 - g) for c, g in zip(counts, good, strict=True)] for y in (0, 1)}
        for y in (0, 1):
            for r in rules:
                sums = {v: belief * before[y][v] + math.fsum(m for m, p in zip(mass[y], votes, strict=True) if p[r] == v) for v in (-1, 0, 1)}
                rates[y][r] = {v: x / sum(sums.values()) for v, x in sums.items()}
        prior = (sum(mass[1]) + 0.8 * belief) / (sum(counts) + belief)
    return [posterior(v) for v in votes]


def planted():
    """Texts by votes of six rules: the first objects at random, the others are right but often abstain on bad texts."""
    rng = np.random.default_rng(4)
    good = rng.random(4000) < 0.75
    votes = np.zeros((4000, 6), int)
    votes[:, 0] = np.where(rng.random(4000) < 0.4, -1, 1)
    for k in range(1, 6):
        roll = rng.random(4000)
        votes[:, k] = np.where(good, np.where(roll < 0.93, 1, 0), np.where(roll < 0.5, 0, np.where(roll < 0.8, -1, 1)))
    return good, votes


def test_fit_equals_brute_force():
    _, votes = planted()
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel.fit(patterns, counts.astype(float))
    want = brute_force([tuple(p) for p in patterns.tolist()], counts.tolist())
    assert np.allclose(model.posterior(patterns), want, atol=1e-6)


def test_verdict_differs_from_all_must_pass_both_ways():
    good, votes = planted()
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    kept = quality.LabelModel.fit(patterns, counts.astype(float)).posterior(votes) >= 0.5
    objection = (votes < 0).any(1)
    assert (kept & objection).sum() > 500  # a rule that is often wrong is overruled
    assert (~kept & ~objection).sum() > 20  # abstentions add up without any objection
    assert (kept == good).mean() > 0.93 > (objection != good).mean() + 0.2


def test_expression_equals_model(spark):
    model = quality.LabelModel.fit(quality.votes_of(np.arange(0, 4**11, 4001)), np.ones(len(range(0, 4**11, 4001))))
    codes = [0, 1, 4**11 - 1, 0b10_01_11_00_10_01_11_00_01_10_11, *range(5, 4**11, 99_991)]
    rows = spark.createDataFrame([(c,) for c in codes], "pattern int").select("pattern", quality.posterior(model).alias("q")).collect()
    want = model.posterior(quality.votes_of(np.array(codes)))
    assert np.allclose([r.q for r in sorted(rows, key=lambda r: codes.index(r.pattern))], want, atol=1e-9)


def test_levels_and_votes_of_texts(spark):
    texts = ["word " * 8, " ".join(f"river{k}" for k in range(60)), " ".join(f"a#{k}" for k in range(60)), None, "x" * 300_000 + " " + " ".join(f"w{k}" for k in range(100))]
    rows = quality.measured(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).select("row.doc_id", quality.pattern().alias("p")).collect()
    votes = {r.doc_id: quality.votes_of(np.array([r.p]))[0].tolist() for r in rows}
    assert votes[0][:2] == [-1, -1] and votes[3][:2] == [-1, -1]
    assert votes[1][0] == 1 and votes[1][4:6] == [1, 0]
    assert votes[2][4:8] == [-1, -1, -1, -1]
    assert votes[4][2:4] == [-1, -1]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_agreement_with_labels(spark, sf):
    """Labels are never used in the fit, so every labelled document that passes the base check is held out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.label == 1) for r in found) >= 0.99 * len(found)


def test_objections_are_overruled_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.measured(docs.select("doc_id", "text")).where(~quality.base_failed()).select("row.doc_id", quality.pattern().alias("p")).collect()
    objecting = {r.doc_id for r, v in zip(rows, quality.votes_of(np.array([r.p for r in rows])), strict=True) if (v < 0).any()}
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    assert len(objecting & kept) > 100 and len(objecting - kept) > 100


def test_stage_keeps_what_the_query_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"row": F.lit(1), "pattern": F.lit("x"), "quality": F.lit(0), "n_words": F.lit(None).cast("int")})
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id for r in quality.quality(docs).where("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert quality.keep(docs.where("false")).collect() == []
    assert want
