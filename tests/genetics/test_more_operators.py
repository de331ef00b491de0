"""Readers, sinks, and numerical operators against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import ancestry, ld, linalg, lookups, popgen, reports, sexbias, synth
from kindred.sources import binary, sinks, tables, text, vcf


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(14)
    m = rng.binomial(2, 0.1 + 0.8 * rng.random(60), (30, 60))
    m[rng.random(m.shape) < 0.08] = -1
    return m


def long(spark, m):
    rows = [(i, f"rs{j:03d}", int(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j] >= 0]
    return spark.createDataFrame(rows, "sample_id long, rsid string, dosage int").repartition(3)


def test_admixture_equals_numpy(spark, matrix):
    d = long(spark, matrix)
    q0, p0 = ancestry.admixture(d, 3, 0)
    q = np.array([r.q for r in q0.orderBy("sample_id").collect()])
    p = np.array([r.p for r in p0.orderBy("rsid").collect()])
    seen, g = matrix >= 0, np.maximum(matrix, 0)
    likelihood = []
    for _ in range(4):
        mean = q @ p.T
        likelihood.append((seen * (g * np.log(mean) + (2 - g) * np.log(1 - mean))).sum())
        up, down = np.where(seen, g / mean, 0), np.where(seen, (2 - g) / (1 - mean), 0)
        a, r = p * (up.T @ q), (1 - p) * (down.T @ q)
        own = q * (up @ p + down @ (1 - p))
        p, q = np.clip(a / (a + r), 1e-6, 1 - 1e-6), own / own.sum(1, keepdims=True)
    got_q, got_p = ancestry.admixture(d, 3, 4)
    assert np.allclose([r.q for r in got_q.orderBy("sample_id").collect()], q, atol=1e-9)
    assert np.allclose([r.p for r in got_p.orderBy("rsid").collect()], p, atol=1e-9)
    assert likelihood == sorted(likelihood)


def test_haploid_males_and_females_alone(spark):
    rows = [(1, "X", "rs1", 2), (1, "X", "rs2", 1), (1, "1", "rs3", 1), (2, "X", "rs1", 1), (3, "X", "rs1", 0), (4, "X", "rs1", None)]
    d = spark.createDataFrame(rows, "sample_id long, chrom string, rsid string, dosage int")
    sexes = spark.createDataFrame([(1, "M"), (2, "F"), (4, "1")], "sample_id long, sex string")
    got = {(r.sample_id, r.rsid): (r.dosage, r.ploidy) for r in ancestry.haploid_males(d, sexes).collect()}
    assert got == {(1, "rs1"): (1, 1), (1, "rs2"): (None, 1), (1, "rs3"): (1, 2), (2, "rs1"): (1, 2), (3, "rs1"): (0, 2), (4, "rs1"): (None, 1)}
    runs = ancestry.headline_and_females(d, sexes, 2, 1).groupBy("run").agg(F.collect_set("sample_id").alias("s")).collect()
    assert {r.run: sorted(r.s) for r in runs} == {"headline_auto": [1], "female_x": [2]}


def test_cross_validation_prefers_the_planted_number(spark):
    people = spark.range(40).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("double").alias("f"), F.lit(False).alias("haploid"))
    sites = spark.range(150).select(F.format_string("rs%d", "id").alias("rsid"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("p_a"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.9).alias("p_b"))
    runs = ancestry.cross_validated(synth.mixed_draw(people, sites).cache(), [1, 2], 2, 8)
    cv = {(r.k, r.rep): r.cv for r in runs.collect()}
    assert len(cv) == 4 and max(cv[2, 0], cv[2, 1]) < min(cv[1, 0], cv[1, 1])


def test_factorisation_nears_the_best_error(spark):
    rng = np.random.default_rng(3)
    w, h = rng.random((25, 2)), rng.random((2, 80)) * 0.5
    x = w @ h
    rows = [(i, f"rs{j}", float(x[i, j])) for i in range(25) for j in range(80)]
    names, found = sexbias.weights(spark.createDataFrame(rows, "sample_id long, rsid string, signal double"), 2)
    assert names == list(range(25)) and (found >= 0).all()
    loadings = np.linalg.lstsq(found, x, rcond=None)[0]
    assert np.abs(found @ loadings - x).max() < 0.02 * x.max()


def test_unit_rows_and_population_components(spark, matrix):
    d = long(spark, matrix)
    got = linalg.unit_rows(d).toPandas().pivot(index="sample_id", columns="rsid", values="x").sort_index().to_numpy()
    x = np.where(matrix < 0, np.nan, matrix).astype(float)
    want = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    assert np.allclose(got, want[:, np.nanstd(x, 0) > 0], equal_nan=True)
    rng = np.random.default_rng(2)
    af = rng.random((4, 50))
    rows = spark.createDataFrame([(f"p{i}", f"1-{j}-A-G", float(af[i, j])) for i in range(4) for j in range(50)], "pop string, locus_key string, allele_freq double")
    for across, own in (("pop", (af - af.mean(1, keepdims=True)) / af.std(1, keepdims=True)), ("locus_key", af - af.mean(0))):
        u, s, _ = np.linalg.svd(own, full_matrices=False)
        for r in linalg.pca(linalg.population_rows(rows, across), 2).collect():
            assert abs(r.score) == pytest.approx(abs(u[int(r.sample_id[1]), r.pc - 1] * s[r.pc - 1]), abs=1e-6)
            assert r.explained == pytest.approx(s[r.pc - 1] ** 2 / (s**2).sum())


def test_gram_in_many_tiles(spark, matrix, monkeypatch):
    x = linalg.centred(long(spark, matrix))
    want = {(r.i, r.j): r.g for r in linalg.gram_sql(x).collect()}
    monkeypatch.setattr(linalg, "TILE", 7)
    got = {(r.i, r.j): r.g for r in linalg.gram(x).collect()}
    assert len(got) == 30 * 31 // 2 and all(got[k] == pytest.approx(v) for k, v in want.items())
    values = {r.pc: r.variance for r in linalg.pca(x, 3).collect()}
    monkeypatch.undo()
    assert values == pytest.approx({r.pc: r.variance for r in linalg.pca(x, 3).collect()})


def test_links_across_stretches(spark):
    rng = np.random.default_rng(6)
    base = rng.binomial(2, 0.5, (40, 1))
    m = np.where(rng.random((40, 90)) < 0.1, rng.binomial(2, 0.5, (40, 90)), base)  # all variants are alike
    rows = [(i, "1", j, f"rs{j:03d}", int(m[i, j])) for i in range(40) for j in range(90)]
    d = spark.createDataFrame(rows, "sample_id long, chrom string, pos long, rsid string, dosage int")
    r2 = np.corrcoef(m.T.astype(float)) ** 2
    want = {(a + 1, b + 1) for a in range(90) for b in range(a + 1, min(90, a + 4)) if r2[a, b] > 0.2}
    assert {(r.a, r.b) for r in ld.links(d, 3, 0.2).collect()} == want


def test_draws_are_by_hash(spark):
    people = spark.createDataFrame([(k, k / 10, k % 2 == 0) for k in range(6)], "sample_id long, f double, haploid boolean")
    sites = spark.createDataFrame([(f"rs{k}", k / 20, 1 - k / 20) for k in range(20)], "rsid string, p_a double, p_b double")
    keys = people.crossJoin(sites).select("sample_id", "rsid", "f", "p_a", "p_b", "haploid", synth.unit(F.col("sample_id"), F.col("rsid"), F.lit(7)).alias("u"), synth.unit(F.col("sample_id"), F.col("rsid"), F.lit(8)).alias("v"))
    want = {}
    for r in keys.collect():
        p = r.f * r.p_a + (1 - r.f) * r.p_b
        want[r.sample_id, r.rsid] = 2 * (r.u < p) if r.haploid else (r.u < p) + (r.v < p)
    assert {(r.sample_id, r.rsid): r.dosage for r in synth.mixed_draw(people, sites).collect()} == want
    panel = spark.range(50).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("superpopulation"))
    order = [(r.superpopulation, r.h, r.sample_id) for r in panel.withColumn("h", F.xxhash64("sample_id", F.lit(7))).collect()]
    want = {s for name in "AB" for _, _, s in sorted(x for x in order if x[0] == name)[:6]}
    assert {r.sample_id for r in synth.frozen_reference(panel, 6).collect()} == want


def test_vcf_of_many_samples(spark, tmp_path):
    names = [f"S{k}" for k in range(300)]
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    lines += ["\t".join(["chr1", str(p), f"rs{p}", "A", "G", ".", "PASS", ".", "GT", *(("0/0", "0|1", "1/1", "./.")[(p + k) % 4] for k in range(300))]) for p in (5, 9)]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    got = {(r.sample_id, r.pos): r.dosage for r in vcf.read_vcf(spark, str(tmp_path / "a.vcf")).collect()}
    assert got == {(f"S{k}", p): (0, 1, 2, None)[(p + k) % 4] for k in range(300) for p in (5, 9)}


def test_first_rows_of_slices_and_key_maps(spark, tmp_path):
    (tmp_path / "chr1.tsv").write_text("chr1\t5\tA\tG\t0.9\t0.1\t.\t0.2\nchr1\t5\tA\tG\t0.1\t0.1\t0.1\t0.1\n")
    (tmp_path / "chr2.tsv").write_text("chr1\t5\tA\tG\t0.0\t0\t0\t0\n2\t7\tC\tT\t.\t0.5\t0.5\t0.5\n")
    slices = tables.reference_slices(spark, str(tmp_path))
    keys = spark.createDataFrame([("1-5-A-G",), ("2-7-C-T",), ("9-9-A-C",)], "locus_key string")
    got = {r[0]: tuple(r)[1:] for r in lookups.keyed_slices(keys, slices).collect()}
    assert got == {"1-5-A-G": (0.9, 0.1, None, 0.2), "2-7-C-T": (None, 0.5, 0.5, 0.5), "9-9-A-C": (None,) * 4}


def test_population_files_read_back(spark, tmp_path):
    af = spark.createDataFrame([("north", "1-5-A-G", "rs5", 0.25, 8), ("north", "1-6-A-G", "rs6", None, 0), ("south", "1-5-A-G", "rs5", 0.5, 4)], "pop string, locus_key string, rsid string, allele_freq double, allele_number long")
    made = sinks.write_populations(af, str(tmp_path))
    assert [m.rsplit("/", 1)[1] for m in made] == ["allele_freq_north.tsv", "allele_freq_south.tsv"]
    (tmp_path / "allele_freq_East_Side.tsv").write_text("locus_key\trsid\tallele_freq\tallele_number\n1-5-A-G\trs5\t1.0\t2\n")
    got = {tuple(r) for r in tables.population_files(spark, str(tmp_path)).collect()}
    assert got == {("north", "1-5-A-G", "rs5", 0.25, 8), ("north", "1-6-A-G", "rs6", None, None), ("south", "1-5-A-G", "rs5", 0.5, 4), ("east_side", "1-5-A-G", "rs5", 1.0, 2)}


def test_loadings_and_scores(spark, tmp_path):
    np.savez(tmp_path / "l.npz", chrom=np.array([b"chr1", b"2"]), pos=np.array([5, 7]), ref=np.array([b"A", b"C"]), alt=np.array([b"G", b"T"]), loadings=np.array([[0.1, 0.2], [0.3, 0.4]]), pca_af=np.array([0.5, 0.0]))
    loads = binary.loadings_npz(spark, str(tmp_path / "l.npz"))
    assert sorted(tuple(r)[:6] for r in loads.collect()) == [("1", 5, "A", "G", [0.1, 0.2], 0.5), ("2", 7, "C", "T", [0.3, 0.4], 0.0)]
    study = spark.createDataFrame([("rs5", "chr1", 5, "G", "A"), ("rs5x", "1", 5, "A", "G"), ("rs7", "2", 7, "T", "C")], "rsid string, chrom string, pos long, a1 string, a2 string")
    assert [r.rsid for r in lookups.allele_matched(study, loads).collect()] == ["rs5"]
    np.savez(tmp_path / "bad.npz", chrom=np.array([b"1"]))
    with pytest.raises(Exception, match="lacks"):
        binary.loadings_npz(spark, str(tmp_path / "bad.npz")).collect()
    meta = json.dumps({"genetic_region": "AFR", "population": "Yoruba"})
    rows = [("a", json.dumps({"pca_scores": [0.5, -1.0]}), meta), ("b", "NA", meta), ("c", "{", meta), ("d", json.dumps({"pca_scores": []}), meta), ("e", json.dumps({"pca_scores": [1.0]}), "{}")]
    scores = tables.panel_scores(spark.createDataFrame(rows, "s string, gnomad_population_inference string, hgdp_tgp_meta string"))
    assert [tuple(r) for r in scores.collect()] == [("a", "AFR", "Yoruba", [0.5, -1.0])]


def test_tables_of_numbers(spark, tmp_path):
    (tmp_path / "x.eigenval").write_text("3.0\n1.0\n")
    values = linalg.explained(tables.eigenval(spark, str(tmp_path / "x.eigenval"))).orderBy("pc").collect()
    assert [(r.pc, r.value, r.percent) for r in values] == [(1, 3.0, 75.0), (2, 1.0, 25.0)]
    (tmp_path / "x.Q").write_text("0.25 0.75\n1.0 0.0\n")
    got = {(r.name, r.component): r.value for r in tables.components(spark, str(tmp_path / "x.Q"), ["s1", "s2"]).collect()}
    assert got == {("s1", 0): 0.25, ("s1", 1): 0.75, ("s2", 0): 1.0, ("s2", 1): 0.0}
    with pytest.raises(ValueError, match="more than 1 rows"):
        tables.components(spark, str(tmp_path / "x.Q"), ["s1"])


def test_samplesheet_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("participant_id,file,site\n" + "".join(f"{'' if k % 2 else f'p{k}'},a{k}.txt,s\n" for k in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    try:
        got = {r.path.rsplit("/", 1)[1]: r.participant_id for r in text.samplesheet(spark, str(tmp_path / "sheet.csv")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"a{k}.txt": f"row_{k + 2}" if k % 2 else f"p{k}" for k in range(40)}


def test_ordered_report(spark, tmp_path):
    rows = [(c, f"p{k % 7}", f"G{k}") for k, c in enumerate(["land", "isle", "cape"] * 20)]
    sinks.write_ordered(spark.createDataFrame(rows, "country string, participant_id string, gene string").repartition(5), str(tmp_path / "r"), ["country", "participant_id", "gene"])
    lines = [x for part in sorted((tmp_path / "r").glob("part-*")) for x in part.read_text().splitlines()]
    assert [tuple(x.split("\t")) for x in lines if not x.startswith("country")] == sorted(rows)


def test_small_cohort_archive(spark, tmp_path):
    rows = [(s, "1", p, f"rs{p}", "A", "G", None if (s + p) % 5 == 0 else (s + p) % 3) for s in range(4) for p in range(1, 7)]
    d = spark.createDataFrame(rows, "sample_id long, chrom string, pos long, rsid string, ref string, alt string, dosage int")
    binary.write_npz(d, str(tmp_path / "c.npz"))
    back = {(r.sample_id, r.rsid): r.dosage for r in binary.read_npz(spark, str(tmp_path / "c.npz")).collect()}
    assert back == {(str(s), r): v for s, _, _, r, _, _, v in rows}
    with pytest.raises(ValueError, match="write Parquet"):
        binary.write_npz(d, str(tmp_path / "d.npz"), most=5)


def test_compartments_have_to_fit(spark):
    rows = lambda samples, ids: spark.createDataFrame([(s, r) for s in samples for r in ids], "sample_id long, rsid string")
    assert lookups.concatenated([rows([1, 2], ["a"]), rows([1, 2], ["x"])]).count() == 4
    with pytest.raises(ValueError, match="samples"):
        lookups.concatenated([rows([1, 2], ["a"]), rows([1], ["x"])])
    with pytest.raises(ValueError, match="variants"):
        lookups.concatenated([rows([1], ["a"]), rows([1], ["a"])])
    assert popgen.set_differences(rows([1], ["a"]), rows([1], ["b"]), "rsid").count() == 2


def test_signatures_of_candidates(spark):
    names = "sample string, gene string, line_number int, haplotype string, rank string, allele string, variant string, rsid string, chrom string, pos string, ref string, alt string, genotype string"
    rows = [
        ("s", "G", 1, "hap 2", "2", "*2", None, "rs5", "1", "5", "A", "G", None),
        ("s", "G", 2, "2", "1", "*3", "*3@x", "", "", "", "", "", None),
        ("s", "G", 3, "", None, "", "v7", "rs7", "", "", "", "", None),
        ("s", "G", 4, None, "10", "*1", "*1", "", "", "", "", "", None),
        ("s", "G", 5, "1", "x", "", "", "", "", "", "", "", "*1/*2"),
        ("s", "H", 1, "odd name", "", "", "", "", "", "", "", "", ""),
    ]
    got = {r.gene: (r.top, r.full) for r in reports.signatures(spark.createDataFrame(rows, names)).collect()}
    assert got["G"] == ("Haplotype1=3:rs7@v7/Haplotype2=1:*3@x", "Haplotype1=3:rs7@v7+x:*1/*2+10:*1/Haplotype2=1:*3@x+2:*2@rs5@1-5-A-G")
    assert got["H"] == ("oddname=1:row1", "oddname=1:row1")


def test_blocks_are_disjoint_and_of_their_pools(spark):
    panel = spark.range(300).select(F.format_string("rs%d", "id").alias("rsid"), F.when(F.col("id") % 3 == 0, "X").otherwise("2").alias("chrom"), F.col("id").alias("pos"))
    loadings = panel.where("pos % 2 = 0")
    got = synth.bias_blocks(panel, loadings, ["a", "b"], 20, 30, 4, 50, 2).collect()
    sizes = {}
    for r in got:
        sizes[r.block] = sizes.get(r.block, 0) + 1
        assert not r.block.startswith("projection") or (r.pos % 2 == 0 and r.chrom == "2")
        assert r.block == "sex_block" or r.chrom == "2"
    assert sizes == {"projection[a]": 20, "projection[b]": 20, "island_structure[a]": 30, "island_structure[b]": 30, "sex_block": 54, "singleton_island[a]": 2, "singleton_island[b]": 2, "singleton_sex": 2}
    assert len({r.rsid for r in got}) == len(got)
    with pytest.raises(ValueError, match="sites for"):
        synth.bias_blocks(panel, loadings, ["a"], 20, 30, 4, 101, 2)


def test_rows_in_order_of_their_clusters(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5.0, 5.0), ("c", 0.1, 0.0), ("d", 5.0, 5.2), ("e", 20.0, 0.0)], "k string, x double, y double")
    order = [r.k for r in linalg.row_order(rows, "k", ["x", "y"]).orderBy("nth").collect()]
    assert sorted(order) == list("abcde") and abs(order.index("a") - order.index("c")) == abs(order.index("b") - order.index("d")) == 1
    assert order.index("e") in (0, 4)


def counting(spark, d):
    """``d``, and how many of its rows were read so far."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return d.mapInArrow(run, d.schema), read


def test_admixture_reads_its_calls_once(spark, matrix):
    d, read = counting(spark, long(spark, matrix))
    q, p = ancestry.admixture(d, 3, 2)
    assert q.count() == 30 and p.count() == 60
    assert read.value == (matrix >= 0).sum()  # however many rounds there are
    none = spark.createDataFrame([(1, "rs1", None)], "sample_id long, rsid string, dosage int")
    assert [x.count() for x in ancestry.admixture(none, 3, 2)] == [0, 0]
