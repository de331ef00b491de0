"""What grows with the tables is read once, in tasks whose number grows too."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import labels
from kindred.operators import admix, ancestry, linalg, lookups, synth
from kindred.plans import files, fixture
from kindred.plans import lookups as pairs
from kindred.plans import text as plans
from kindred.plans.registry import queries
from kindred.sources import discovery, ranges, text

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counting(spark, d):
    """``d``, and how many of its rows were read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return d.mapInArrow(run, d.schema), read


@pytest.fixture
def calls(spark):
    rows = [(s, "1" if v % 3 else "X", v, f"rs{v}", (s * v) % 3, "AG") for s in range(6) for v in range(20)]
    return spark.createDataFrame(rows, "sample_id int, chrom string, pos long, rsid string, dosage int, gt string")


def test_f2_three_runs_read_the_calls_once(spark, calls):
    d, read = counting(spark, calls)
    sexes = spark.createDataFrame([(s, "F" if s % 2 else "M") for s in range(6)], "sample_id int, sex string")
    assert ancestry.headline_and_females(d, sexes, 2, 1).count() == 2 * (6 + 3 + 3)
    assert read.value == 120


def test_f3_people_meet_sites_without_pairs_of_partitions(spark):
    people = spark.range(20).select(F.col("id").alias("sample_id"), F.lit(0.5).alias("f"), F.lit(False).alias("haploid"))
    sites = spark.range(30).select(F.concat(F.lit("rs"), "id").alias("rsid"), F.lit(0.1).alias("p_a"), F.lit(0.2).alias("p_b")).distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        drawn = synth.mixed_draw(people, sites)
        assert drawn.count() == 600
        assert "CartesianProduct" not in plan(drawn) and "Exchange hash" not in plan(drawn)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_people_of_one_file_are_drawn_by_many_tasks(spark, monkeypatch):
    people = spark.range(0, 20, 1, 1).select(F.col("id").alias("sample_id"), F.lit(0.5).alias("f"), F.lit(False).alias("haploid"))
    sites = spark.range(30).select(F.concat(F.lit("rs"), "id").alias("rsid"), F.lit(0.1).alias("p_a"), F.lit(0.2).alias("p_b"))
    for draws, tasks in ((synth.TASK_DRAWS, spark.sparkContext.defaultParallelism), (60, 10)):
        monkeypatch.setattr(synth, "TASK_DRAWS", draws)
        drawn = synth.mixed_draw(people, sites)
        assert drawn.select(F.spark_partition_id().alias("task"), "sample_id").groupBy("task").count().count() == tasks
        assert drawn.distinct().count() == 600


def test_f4_f10_ranges_grow_and_small_files_share_tasks():
    assert files.range_bytes(1000) == files.RANGE_BYTES and files.range_bytes(1 << 50) == ranges.RANGE_BYTES
    assert files.range_bytes(256 << 20) == 1 << 20
    reader = ranges.RangeReader({"files": ranges.json.dumps([(f"/f{k}", 3000 + k) for k in range(1000)]), "range_bytes": str(1 << 20)})
    parts = reader.partitions()
    assert len(parts) < 5 and sum(len(p.parts) for p in parts) == 1000


def test_f6_lines_of_a_shared_file_are_counted_once(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"f{k}.txt").write_text("x\n" * k)
    sheet = spark.createDataFrame([(f"s{k}", str(tmp_path / f"f{k % 5}.txt")) for k in range(10)], "participant_id string, path string")
    found = discovery.inputs(spark, [], sheet)
    got = {(r.participant_id, r.lines) for r in discovery.line_counts(spark, found).collect()}
    assert got == {(f"s{k}", k % 5) for k in range(10) if 0 < k % 5 < 4}
    lines, _ = discovery.scan(spark, found)
    assert got == {(r.participant_id, r["count"]) for r in lines.groupBy("participant_id").count().collect()}


@pytest.mark.parametrize("name", ["s18_counts", "s18_keyed_af", "s22_loadings"])
def test_f5_f7_f8_no_task_numbers_all_lines(spark, name):
    assert not re.search(r"windowspecdefinition\(l_orderkey", plan(queries()[name](spark, SF)))


def test_f15_f17_windows_are_aggregations(spark, calls):
    rows = calls.select(F.lit("p").alias("participant_id"), F.lit("f").alias("file"), F.col("pos").alias("line_number"), (F.col("pos") % 4).alias("variant_id"), "gt")
    assert "Window" not in plan(text.merge_replicates(rows))
    panel = calls.select("chrom", "pos", F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    assert "Window" not in plan(lookups.panel_dosages(calls.withColumn("line_number", F.col("pos")), panel))


def test_f16_f21_lines_are_made_once(spark):
    for df in plans.sorted_files(spark, SF):
        assert "lineitem" not in plan(df)


def test_f18_f19_partitions_of_samples_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(fixture, "PARTITION_ROWS", 500)
    assert fixture.genotypes(spark, SF).rdd.getNumPartitions() >= 10


def test_f9_f11_f14_calls_are_read_once(spark, calls):
    for f in (linalg.centred, linalg.standardised):
        d, read = counting(spark, calls)
        linalg.pca(f(d), 2).count()
        assert read.value == 120
    loads, read = counting(spark, spark.createDataFrame([(f"rs{v}", [0.5], 0.3) for v in range(20)], "rsid string, loadings array<double>, pca_af double"))
    linalg.project(calls, loads).count()
    assert read.value == 20


def test_f23_compartments_are_read_once(spark, calls):
    auto, read = counting(spark, calls.where("chrom <> 'X'"))
    assert lookups.concatenated([auto, calls.where("chrom = 'X'")]).count() == 120
    assert read.value == calls.where("chrom <> 'X'").count()


def test_f2_three_runs_make_a_pass_a_round(spark, calls, monkeypatch):
    passes, once = [], ancestry.one_round
    monkeypatch.setattr(ancestry, "one_round", lambda *a, **k: passes.append(1) or once(*a, **k))
    monkeypatch.setattr(ancestry, "CALLS", 7)
    sexes = spark.createDataFrame([(s, "F" if s % 2 else "M") for s in range(6)], "sample_id int, sex string")
    got = {(r.run, r.sample_id, r.component): r.q for r in ancestry.headline_and_females(calls, sexes, 2, 3).collect()}
    assert len(passes) == 3
    auto, females = calls.where("chrom <> 'X'"), calls.where("sample_id % 2 = 1")
    for run, rows in {"headline_auto": auto, "female_auto": females.where("chrom <> 'X'"), "female_x": females.where("chrom = 'X'")}.items():
        alone = {(run, r.sample_id, r.component): r.q for r in ancestry.admixture_em(rows, 2, 3, 9).collect()}
        assert alone.keys() == {k for k in got if k[0] == run} and all(abs(got[k] - q) < 1e-12 for k, q in alone.items())


def test_f12_calls_are_read_once_and_old_rounds_go(spark, calls, monkeypatch):
    d, read = counting(spark, calls)
    gone, discard = [], admix.discard
    monkeypatch.setattr(admix, "discard", lambda df: gone.append(1) or discard(df))
    fits = admix.fit(d, [admix.Model(2), admix.Model(2, 8, 1)], 2, most_rounds=4, tolerance=-1)
    assert read.value == 120 and len(gone) == 5  # the calls as they came, the packed ones, three rounds
    assert fits.p.count() == 40 and fits.q.count() == 24


def test_f12_likelihood_of_products(monkeypatch):
    rng = np.random.default_rng(3)
    q, p = rng.dirichlet(np.ones(3), 40), rng.choice([admix.LEAST, 0.3, 1 - admix.LEAST], (70, 3))
    for ploidy in (1, 2, 5, 60):
        alt = rng.integers(0, ploidy + 1, (70, 40)).astype(np.uint8)
        ref = np.where(rng.random(alt.shape) < 0.2, 0, ploidy - alt).astype(np.uint8)
        up = p @ q.T
        a, r = alt / up, ref / (1 - up)
        likelihood, after, add = admix.expectation(admix.counted(alt, ref), q, p)
        assert np.isclose(likelihood, (alt * np.log(up) + ref * np.log1p(-up)).sum(), rtol=1e-9)
        ups, downs = p * (a @ q), (1 - p) * (r @ q)
        assert np.allclose(after, admix.bounded(ups / (ups + downs))) and np.allclose(add, a.T @ p + r.T @ (1 - p))


def test_f13_workers_are_given_few_rows(spark, calls, monkeypatch):
    whole = admix.fit(calls, [admix.Model(2, 7, f) for f in (0, 1)], 2, most_rounds=3).runs.collect()
    matrix = admix.matrix

    def few(column, *rest):
        assert len(column) <= 2
        return matrix(column, *rest)

    monkeypatch.setattr(admix, "matrix", few)
    monkeypatch.setattr(admix, "GIVEN", 12)  # two rows of six samples
    monkeypatch.setattr(admix, "CELLS", 6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = admix.fit(calls, [admix.Model(2, 7, f) for f in (0, 1)], 2, most_rounds=3).runs.collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert [r.fold for r in rows] == [0, 1] and all(abs(a.cv - b.cv) < 1e-9 and abs(a.likelihood - b.likelihood) < 1e-9 for a, b in zip(rows, whole, strict=True))


def test_f22_parts_of_tokens_are_computed_once(spark):
    sites = spark.createDataFrame([([("chr1", 5, "A", "G, T", "./01")],)], "v array<struct<chrom:string,pos:long,ref:string,alt:string,gt:string>>")
    df = sites.select(labels.raw_allele_tokens(F.col("v")).alias("tokens"))
    assert df.first()[0] == "chr1:5:A>G=./0"  # 01 is the first alternate by number, not by its spelling
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 3
    found = plan(queries()["x29_raw_alleles"](spark, SF))
    assert "partial_collect_list" not in found.split("Exchange")[-1]  # sites are dealt before they meet


@pytest.fixture
def fits(monkeypatch):
    """What ``admix.fit`` was called with and gave, call by call."""
    made, fit = [], admix.fit

    def kept(d, models, *rest, **more):
        made.append((d, models, fit(d, models, *rest, **more)))
        return made[-1][2]

    monkeypatch.setattr(admix, "fit", kept)
    return made


def test_cross_validation_goes_on_to_the_end(spark, calls, fits, monkeypatch):
    monkeypatch.setattr(pairs, "dosages", lambda *_: calls)
    rows = {(r.k, r.rep): r.cv for r in queries()["m10_cross_validation"](spark, SF).collect()}
    assert rows.keys() == {(k, fold) for k in (2, 3) for fold in range(5)} and all(cv > 0 for cv in rows.values())
    assert all(r.converged for r in fits[0][2].runs.collect())


def test_headline_and_females_go_on_to_the_end(spark, calls, fits, monkeypatch):
    monkeypatch.setattr(pairs, "dosages", lambda *_: calls.withColumn("sex", F.when(F.col("sample_id") % 2 == 1, "F").otherwise("M")))
    got = {(r.run, r.sample_id, r.component): r.q for r in queries()["m11_headline_and_females"](spark, SF).collect()}
    assert {k[:2] for k in got} == {("headline_auto", s) for s in range(6)} | {(run, s) for run in ("female_auto", "female_x") for s in (1, 3, 5)}
    together = {r.model: r for r in fits[0][2].runs.collect()}
    assert len(fits) == 1 and all(r.converged for r in together.values())
    assert fits[0][2].p.where("model = 2").count() == calls.where("chrom = 'X'").select("rsid").distinct().count()
    alone = admix.fit(calls.where("chrom = 'X' and sample_id % 2 = 1"), [admix.Model(2, 9)], most_rounds=None, relax=True)
    assert abs(alone.runs.first().likelihood - together[2].likelihood) < 1e-6
    assert all(abs(got["female_x", r.sample_id, r.component] - r.q) < 1e-4 for r in alone.q.collect())


@pytest.mark.parametrize("ploidy", [1, 2, 7])
def test_relaxed_steps_never_lower_the_likelihood(ploidy):
    rng = np.random.default_rng(ploidy)
    for k in (1, 2, 4):
        alt = rng.integers(0, ploidy + 1, (30, 12)).astype(np.uint8)
        ref = np.where(rng.random(alt.shape) < 0.3, 0, ploidy - alt).astype(np.uint8)
        alt[0] = ref[0] = 0  # no call
        c, at = admix.counted(alt, ref), -np.inf
        q, p = admix.proportions(rng.dirichlet(np.full(k, 0.2), 12)), rng.choice([admix.LEAST, 0.4, 1 - admix.LEAST], (30, k))
        for _ in range(60):
            likelihood, slopes = admix.ascent(c, q, np.ascontiguousarray(q.T), admix.products(q), p)
            after = admix.relaxed_p(p, slopes)
            between = admix.log_chance(c, after @ q.T, 1 - after @ q.T)
            assert likelihood >= at - 1e-6 and between >= likelihood - 1e-6
            sums = admix.pulls(*admix.numbers(alt, ref), np.ascontiguousarray(q.T), after)
            q, p, at = admix.proportions(admix.relaxed_q(q, sums)), after, between
            assert np.allclose(q.sum(1), 1) and q.min() > 0 and p.min() >= admix.LEAST and p.max() <= 1 - admix.LEAST
        # No small step of EM does any better at the end.
        once, _, add = admix.expectation(c, q, p)
        assert admix.expectation(c, admix.proportions(q * add), p)[0] - once < 1
