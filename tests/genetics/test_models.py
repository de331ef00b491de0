"""Admixture models to convergence, all in one run, and components of many samples, against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import admix, linalg


def planted(n, m, k, seed):
    rng = np.random.default_rng(seed)
    q = rng.dirichlet(np.full(k, 0.3), n)
    p = rng.beta(0.6, 0.6, (m, k)).clip(0.02, 0.98)
    g = rng.binomial(2, (q @ p.T))
    g[rng.random(g.shape) < 0.1] = -1
    return q, p, g


def as_rows(spark, g):
    rows = [(i, f"rs{j}", int(g[i, j])) for i in range(g.shape[0]) for j in range(g.shape[1]) if g[i, j] >= 0]
    return spark.createDataFrame(rows, "sample_id long, rsid string, dosage int").repartition(5).withColumn("ploidy", F.lit(2)).cache()


def likelihood(g, q, p):
    up = q @ p.T
    return float(np.where(g >= 0, g * np.log(up) + (2 - g) * np.log(1 - up), 0).sum())


@pytest.fixture(scope="module")
def cohort(spark):
    q, p, g = planted(24, 200, 3, 5)
    return q, p, g, as_rows(spark, g)


def test_likelihood_never_falls_and_needs_fewer_rounds(spark, cohort):
    true_q, _, g, d = cohort
    fast = admix.fit(d, [admix.Model(3, 1)], most_rounds=30)
    slow = admix.fit(d, [admix.Model(3, 1)], most_rounds=30, tolerance=-1, accelerate=False)
    a, b = fast.runs.first(), slow.runs.first()
    for fits in (fast, slow):
        steps = [r.likelihood for r in fits.trace.orderBy("round").collect()]
        assert len(steps) > 3 and all(y >= x - 1e-6 for x, y in zip(steps, steps[1:], strict=False))
    cycles = [r.likelihood for r in fast.trace.orderBy("round").collect()]
    reached = next(3 * k for k, x in enumerate(cycles) if x >= b.likelihood)  # rounds to where 30 of the plain kind come
    assert reached < 30 == b.rounds
    q = fast.q.toPandas().pivot(index="sample_id", columns="component", values="q").to_numpy()
    p = np.array([r.p for r in fast.p.toPandas().assign(n=lambda f: f.rsid.str[2:].astype(int)).sort_values("n").itertuples()])
    assert np.allclose(q.sum(1), 1) and likelihood(g, q, p) >= a.likelihood - 1e-6
    assert min(np.abs(q[:, list(o)] - true_q).mean() for o in itertools.permutations(range(3))) < 0.2


def test_models_in_one_run_equal_runs_of_one(spark, cohort):
    d = cohort[3]
    models = [admix.Model(2, 3), admix.Model(3, 4, 0), admix.Model(1, 5, 1)]
    together = admix.fit(d, models, 2, tolerance=2.0, most_rounds=7)
    rows = {r.model: r for r in together.runs.collect()}
    assert together.jobs == max(r.rounds for r in rows.values())  # not their sum
    for i, m in enumerate(models):
        alone = admix.fit(d, [m], 2, tolerance=2.0, most_rounds=7)
        r = alone.runs.first()
        assert (r.rounds, r.converged) == (rows[i].rounds, rows[i].converged) and abs(r.likelihood - rows[i].likelihood) < 1e-6
        assert (r.cv is None) == (m.fold is None) and (r.cv is None or abs(r.cv - rows[i].cv) < 1e-9)


def test_a_round_equals_expectation_maximisation(spark, cohort):
    _, _, g, d = cohort
    m = admix.Model(2, 9)
    names = list(range(len(g)))
    q = admix.proportions(0.5 + np.array([admix.uniform(str(s), 9, 2) for s in names]))
    alt, ref = np.where(g >= 0, g, 0), np.where(g >= 0, 2 - g, 0)
    p = np.array([admix.start_p(f"rs{j}", alt[:, j], ref[:, j], [m]) for j in range(g.shape[1])])
    for _ in range(4):
        up = q @ p.T
        a, r = alt / up, ref / (1 - up)
        ups, downs = p * (a.T @ q), (1 - p) * (r.T @ q)
        q, p = admix.proportions(q * (a @ p + r @ (1 - p))), admix.bounded(ups / (ups + downs))
    got = admix.fit(d, [m], most_rounds=4, tolerance=-1, accelerate=False)
    found = got.q.toPandas().pivot(index="sample_id", columns="component", values="q").to_numpy()
    assert np.allclose(found, q)
    assert np.allclose(np.array([r.p for r in got.p.toPandas().assign(n=lambda f: f.rsid.str[2:].astype(int)).sort_values("n").itertuples()]), p)


def test_models_of_nothing(spark):
    none = spark.createDataFrame([("a", "rs1", None)], "sample_id string, rsid string, dosage int")
    fits = admix.fit(none, [admix.Model(2)])
    assert fits.q.count() == fits.p.count() == 0 and fits.runs.first().likelihood is None


def test_randomised_components_equal_exact_ones(spark, cohort):
    x = linalg.standardised(cohort[3])
    exact = linalg.pca(x, 5).toPandas().sort_values(["pc", "sample_id"])
    for oversample in (10, 60):
        got = linalg.randomised_pca(x, 5, oversample, most_rounds=60, tolerance=1e-13).toPandas().sort_values(["pc", "sample_id"])
        assert np.allclose(np.sqrt(got["variance"]), np.sqrt(exact["variance"]), rtol=1e-6)
        assert np.allclose(got["score"], exact["score"], atol=1e-3) and np.allclose(got["explained"], exact["explained"], rtol=1e-6)
    some = linalg.pca(x, 5, of_emitted=True).groupBy("sample_id").agg(F.sum("explained").alias("s")).first()
    assert abs(some.s - 1) < 1e-9
    assert linalg.randomised_pca(x.limit(0)).count() == 0


def test_components_of_a_hundred_thousand_samples(spark, monkeypatch):
    """Two groups by ten variants; no matrix of samples by samples, and blocks of samples that are added up apart."""
    monkeypatch.setattr(linalg, "BLOCK", 1 << 14)
    d = spark.range(100_000).select(F.col("id").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("v"))
    one = F.pmod(F.xxhash64("sample_id", "v"), F.lit(100)) < F.when((F.col("sample_id") % 2 == 0) == (F.col("v") % 2 == 0), 85).otherwise(15)
    x = linalg.standardised(d.select("sample_id", F.format_string("rs%d", "v").alias("rsid"), F.when(one, 2).otherwise(0).alias("dosage")))
    rows = linalg.randomised_pca(x, 2, 4)
    assert rows.count() == 200_000
    sides = rows.where("pc = 1").groupBy(F.col("sample_id") % 2).agg(F.avg("score").alias("m"), F.avg((F.col("score") > 0).cast("int")).alias("s")).collect()
    assert sides[0].m * sides[1].m < 0 and all(r.s > 0.95 or r.s < 0.05 for r in sides)


def test_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(linalg, "FAN_IN", 2)
    rows = [(k % 3, np.full(4, float(k)).tobytes()) for k in range(50)]
    parts = spark.createDataFrame(rows, "a int, cells binary").repartition(9)
    got = {r.a: np.frombuffer(r.cells).tolist() for r in linalg.added_up(parts, ["a"]).collect()}
    assert got == {a: [float(sum(range(a, 50, 3)))] * 4 for a in range(3)}
