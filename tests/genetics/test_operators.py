"""Operators that SQL can't express, and file round trips, against small independent computations."""

import itertools
import math
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import genotype as G
from kindred.functions import labels as L
from kindred.operators import ancestry, counts, filters, ld, linalg, popgen, qc, sexbias, synth
from kindred.sources import binary, plink, sinks, tables, text, vcf


def long_dosages(spark, matrix, chroms=None):
    rows = [(i, (chroms or ["1"] * matrix.shape[1])[j], j * 10 + 10, f"rs{j}", "A", "G", None if matrix[i, j] < 0 else int(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "sample_id long, chrom string, pos long, rsid string, ref string, alt string, dosage int")


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(4)
    m = rng.binomial(2, rng.random(40), (25, 40))
    for j in range(0, 39, 4):
        m[:, j + 1] = m[:, j]
    m[rng.random(m.shape) < 0.05] = -1
    return m


def test_hwe_exact_equals_enumeration():
    def brute(het, a, b):
        n, rare = het + a + b, 2 * min(a, b) + het
        if not n:
            return 1.0
        def p(h):
            x, y = (rare - h) // 2, n - (rare - h) // 2 - h
            return 2**h * math.factorial(n) / (math.factorial(x) * math.factorial(h) * math.factorial(y))
        all_p = [p(h) for h in range(rare % 2, rare + 1, 2)]
        return sum(x for x in all_p if x <= p(het) * (1 + 1e-9)) / sum(all_p)

    for het, a, b in itertools.product(range(6), range(6), range(6)):
        assert filters.hwe_exact_p(het, a, b) == pytest.approx(brute(het, a, b))


def test_chi2_threshold_is_the_p_value(spark):
    df = spark.createDataFrame([(15.136705226623,), (None,)], "x double").select(filters.chi2_p(F.col("x")).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([1e-4, 1.0])


def test_prune_equals_brute_force(spark, matrix):
    chroms = ["1"] * 20 + ["2"] * 20
    kept = {r.rsid for r in ld.prune(long_dosages(spark, matrix, chroms), 5, 0.2).collect()}
    want = []
    for chrom in "12":
        mine = [j for j in range(40) if chroms[j] == chrom]
        stay = []
        for place, j in enumerate(mine):
            def standard(k):
                x = matrix[:, k].astype(float)
                x = np.where(x < 0, x[x >= 0].mean(), x)
                return x - x.mean()
            x = standard(j)
            def r2(k):
                y = standard(k)
                d = (x @ x) * (y @ y)
                return (x @ y) ** 2 / d if d else 0.0
            if not any(place - p <= 5 and r2(k) > 0.2 for p, k in stay):
                stay.append((place, j))
        want += [f"rs{j}" for _, j in stay]
    assert kept == set(want)


def test_pca_equals_svd(spark, matrix):
    got = linalg.pca(linalg.centred(long_dosages(spark, matrix)), 3).collect()
    x = matrix.astype(float)
    x = np.where(x < 0, np.nan, x)
    x = np.nan_to_num(x - np.nanmean(x, axis=0))
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    for r in got:
        assert abs(r.score) == pytest.approx(abs(u[r.sample_id, r.pc - 1] * s[r.pc - 1]), abs=1e-6)
        assert r.variance == pytest.approx(s[r.pc - 1] ** 2 / 24)
        assert r.explained == pytest.approx(s[r.pc - 1] ** 2 / (s**2).sum())


def test_grams_agree(spark, matrix):
    x = linalg.standardised(long_dosages(spark, matrix))
    a = {(r.i, r.j): r.g for r in linalg.gram(x).collect()}
    b = {(r.i, r.j): r.g for r in linalg.gram_sql(x).collect()}
    assert all(a[k] == pytest.approx(v) for k, v in b.items())


def test_upgma():
    d = np.array([[0, 2, 6, 10], [2, 0, 6, 10], [6, 6, 0, 10], [10, 10, 10, 0]], float)
    assert [(h, n) for _, _, h, n in linalg.upgma(list("abcd"), d)] == [(2, 2), (6, 3), (10, 4)]


def test_fst_of_equal_and_of_fixed_populations(spark):
    rows = [(p, f"1-{k}-A-G", 0.5 if p != "c" else 1.0, 40) for p in "abc" for k in range(5)]
    got = {(r.pop1, r.pop2): r.fst for r in popgen.pairwise_fst(spark.createDataFrame(rows, "pop string, locus_key string, allele_freq double, allele_number long")).collect()}
    assert got["a", "b"] < 0 < got["a", "c"] < 1
    bad = spark.createDataFrame([("x",), ("x",)], "locus_key string")
    with pytest.raises(ValueError, match="not unique"):
        popgen.require_unique(bad, ["locus_key"])


def test_nmf_rows_add_up(spark):
    rng = np.random.default_rng(1)
    rows = [(s, "auto", f"rs{v}", "1", v, int(rng.random() < (0.9 if (v < 30) == (s < 10) else 0.1))) for s in range(20) for v in range(60)]
    got = sexbias.nmf(spark.createDataFrame(rows, "sample_id long, region string, rsid string, chrom string, pos long, signal int"), 2).toPandas()
    q = got.pivot(index="sample_id", columns="component", values="q").to_numpy()
    assert np.allclose(q.sum(1), 1)
    assert (q[:10].argmax(1) == q[0].argmax()).all() and (q[10:].argmax(1) != q[0].argmax()).all()


def test_admixture_separates_planted_groups(spark):
    people = spark.range(24).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("double").alias("f"), F.lit(False).alias("haploid"))
    sites = spark.range(120).select(F.format_string("rs%d", "id").alias("rsid"), F.when(F.col("id") % 2 == 0, 0.95).otherwise(0.05).alias("p_a"), F.when(F.col("id") % 2 == 0, 0.05).otherwise(0.95).alias("p_b"))
    q = ancestry.admixture_em(synth.mixed_draw(people, sites), 2, 15).toPandas().pivot(index="sample_id", columns="component", values="q")
    assert np.allclose(q.sum(axis=1), 1)
    assert abs(q[0][::2].mean() - q[0][1::2].mean()) > 0.8


def test_bed_round_trip(spark, matrix, tmp_path):
    d = long_dosages(spark, matrix).withColumnsRenamed({"ref": "a2", "alt": "a1"})
    prefix = str(tmp_path / "cohort")
    plink.write_bed(d, prefix)
    back = plink.read_bed(spark, prefix)
    want = {(str(r.sample_id), r.rsid, r.pos, r.a1, r.a2, r.dosage) for r in d.collect()}
    assert {(r.sample_id, r.rsid, r.pos, r.a1, r.a2, r.dosage) for r in back.collect()} == want
    assert (tmp_path / "cohort.bed").read_bytes()[:3] == plink.MAGIC
    encoded = plink.encoded(d, list(range(25)))
    assert plink.subset(encoded, encoded.limit(3)).count() == 3
    x = np.array([2, 1, 0, -1, 2])
    assert plink.pack(x) == bytes([0b01111000, 0b00000000]) and plink.unpack(plink.pack(x), 5).tolist() == x.tolist()


def test_vcf_round_trip(spark, matrix, tmp_path):
    d = long_dosages(spark, matrix).withColumn("sample_id", F.format_string("S%02d", "sample_id"))
    vcf.write_vcf(d, str(tmp_path / "v"))
    want = {(r.sample_id, r.rsid, r.dosage) for r in d.collect()}
    assert {(r.sample_id, r.rsid, r.dosage) for r in vcf.read_vcf(spark, str(tmp_path / "v")).collect()} == want


@pytest.fixture
def folder(tmp_path):
    good = "rsid\tchrom\tpos\tgt\tgs\tbaf\tlrr\r\nrs1\tchr1\t100\tag\t0.9\t0.5\t0.1\r\nAX-1\t2\t200\tTT\t\tx\t0.1\textra\n.\tX\t300\t--\t0.5\tnan\tnan\n\trs9\n\t1\t5\tAA\t1\t1\t1\nrs1\t1\t100\tAA\t0.9\t0.5\t0.1\nrs2\t1\t1.5\tAA\t0.9\t0.5\t0.1\n"
    report = "[Header]\nx\n[Data]\nSNP Name\tChr\tPosition\tAllele1 - Plus\tAllele2 - Plus\nGSA-rs7\t1\t10\tA\tG\nilmn2\t1\t20\tA\t-\nGSA-rs7_dup\t1\t10\tA\tA\nbad\t1\tx\tA\tA\nGSA-rs7\t0\t10\tA\tZ\nfew\t1\n"
    for name, content in (("p1", good), ("p2", report), ("p3", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text(content)
    return str(tmp_path)


def test_reads_text_files(spark, folder):
    lines = text.read_lines(spark, folder).cache()
    assert {(r.file.split("/")[-2], r.format) for r in text.sniff(lines).collect()} == {("p1", "ddna"), ("p2", "illumina")}  # p3 has no line
    p1 = lines.where("participant_id = 'p1'")
    rows = text.ddna(p1).orderBy("line_number").collect()
    assert [(r.variant_id, r.chrom, r.pos, r.gt, r.gs) for r in rows] == [("rs1", "1", 100, "AG", 0.9), ("rsAX-1", "2", 200, "TT", None), ("X:300", "X", 300, "--", 0.5), ("rs1", "1", 100, "AA", 0.9)]
    mapped = text.ddna(p1, spark.createDataFrame([("2", 200, "rs77")], "chrom string, pos long, rsid string"))
    assert "rs77" in {r.variant_id for r in mapped.collect()}
    found = text.illumina(lines.where("participant_id = 'p2'")).collect()
    assert {(r.variant_id, r.gt) for r in found} == {("rs7", "--"), ("1:20", "--")}


def test_line_issues(spark, folder, tmp_path):
    lines, files = text.read_lines(spark, folder), text.list_files(spark, folder)
    codes = sorted((r.line_number, r.code) for r in qc.ddna_issues(lines.where("participant_id = 'p1'")).collect())
    assert codes == [(3, "INVALID_BAF"), (3, "MISSING_GS"), (5, "DDNA_FIELD_COUNT"), (7, "CONFLICTING_DUPLICATE_RSID"), (8, "INVALID_POSITION")]
    codes = sorted((r.line_number, r.code) for r in qc.illumina_issues(lines.where("participant_id = 'p2'")).collect())
    assert codes == [(6, "INVALID_GENOTYPE"), (8, "INVALID_POSITION"), (9, "DUPLICATE_PROBE"), (9, "INVALID_GENOTYPE"), (10, "ILLUMINA_FIELD_COUNT")]
    whole = qc.file_issues(files, lines.where("participant_id <> 'p2'"))
    assert {(r.participant_id, r.code) for r in whole.collect() if r.participant_id == "p3"} == {("p3", "FILE_EMPTY")}
    issues = qc.ddna_issues(lines.where("participant_id = 'p1'")).unionByName(whole.where("participant_id = 'p3'"))
    sinks.write_reports(files, issues, str(tmp_path / "out"))
    report = spark.read.json(str(tmp_path / "out/report")).first()
    assert (report.files, report.files_with_file_errors, report.bad_lines, report.usable_percent) == (3, 1, 3, 66.67)
    assert spark.read.csv(str(tmp_path / "out/warnings"), sep="\t", header=True).count() == 2


def test_samplesheet_and_maps(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Sample_ID,File,country,sex\nA,x.txt,Lor, \n,/abs/y.txt,,F\n")
    rows = text.samplesheet(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.participant_id, r.path, r.facets) for r in rows] == [("A", f"{tmp_path}/x.txt", {"country": "Lor", "sex": ""}), ("row_3", "/abs/y.txt", {"country": "", "sex": "F"})]
    (tmp_path / "m.tsv").write_text("chr\tposition\tid\n1\t5\t7\n1\t5\trs7\n1\t6\trs1\n1\t6\trs2\n1\tx\trs3\n2\t8\t.\n")
    assert [tuple(r) for r in text.locus_map(spark, str(tmp_path / "m.tsv")).collect()] == [("1", 5, "rs7")]
    with pytest.raises(Exception, match="no column"):
        text.simple_table(spark, str(tmp_path / "m.tsv")).collect()


def test_populations():
    assert tables.populations("", ["b", "a"]) == ["a", "b"]
    assert tables.populations("B , a,b", ["b", "a"]) == ["b", "a"]
    with pytest.raises(ValueError, match="no table"):
        tables.populations("z", ["a"])


def test_reports_and_wide_tables(spark):
    lines = spark.createDataFrame([("p", "f", k, x) for k, x in enumerate(["title", "Gene\tSource Diplotype\tPhenotype", "G1\t*1/*2\tpoor"])], "participant_id string, file string, line_number int, line string")
    assert [tuple(r) for r in tables.pgx_report(lines).collect()] == [("p", "G1", "*1/*2", "poor")]
    df = spark.createDataFrame([("G", "", "*1", "*2")], "Gene string, Genotype string, `Haplotype 1` string, Haplotype_2 string")
    assert tables.caller_results(df).first().genotype == "*1/*2"
    wide = spark.createDataFrame([("v", "0.5", "NaN", "", "1")], "Name string, `a.B Allele Freq` string, `a.Log R Ratio` string, `b.B Allele Freq` string, `b.Log R Ratio` string")
    assert sorted(tuple(r) for r in tables.intensity_long(wide).collect()) == [("v", "a", 0.5, 0.0), ("v", "b", 0.0, 1.0)]
    files = spark.createDataFrame([("/d/1_Red.idat",), ("/d/1_Grn.idat",), ("/d/2_Red.idat.gz",)], "file string")
    got = {(r.sample_id, r.problem) for r in tables.array_pairs(files, spark.createDataFrame([("1", "s1")], "chip string, sample_id string")).collect()}
    assert got == {("s1", ""), ("2", "missing_green")}
    meta = spark.createDataFrame([("a", '{"project": "P", "population": "", "genetic_region": "SAS"}'), ("b", "{}")], "sample_id string, hgdp_tgp_meta string")
    assert [tuple(r) for r in tables.panel_json(meta).collect()] == [("a", "P", "CSA")]
    assert tables.score_arrays(spark.createDataFrame([("a", "[1.5, 2]"), ("b", "x")], "sample_id string, scores string")).count() == 1


def test_label_functions(spark):
    df = spark.createDataFrame([("Black and White / Mixed; black", "a\x01b\t\r\n", '{"b": 1}')], "a string, line string, j string")
    row = df.select(L.ancestries(F.col("a")).alias("a"), L.report_line(F.col("line")).alias("l"), L.hla_allele(F.lit("A"), F.lit("0201")).alias("h"), L.hla_allele(F.lit("A"), F.lit("0")).alias("z")).first()
    assert row.a == ["black", "white", "mixed"] and row.l == "a\\x01b\t" and (row.h, row.z) == ("HLA-A*02:01", "0")
    v = spark.createDataFrame([([("chr1", 5, "A", "G,T", "1|2"), ("chr1", 4, "C", "T", "0/0")],)], "v array<struct<chrom:string,pos:long,ref:string,alt:string,gt:string>>")
    assert v.select(L.raw_allele_tokens(F.col("v"))).first()[0] == "chr1:5:A>G=1|0;chr1:5:A>T=0|1"
    assert df.select(G.percent(F.lit(1), F.lit(3)), G.percent(F.lit(1), F.lit(0))).first()[:] == (33.33, 0.0)


def test_cohorts_repeat(spark):
    plan = synth.cohort_plan(spark, 100, ["a", "b"])
    assert plan.where("sex = 'M'").count() == 55
    assert {r["count"] for r in synth.assign_islands(plan, ["x", "y", "z", "w"]).groupBy("island").count().collect()} == {25}
    panel = spark.range(50).select(F.format_string("rs%d", "id").alias("rsid"), F.lit("X").alias("chrom"), F.col("id").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    sizes = {r.block: r["count"] for r in synth.blocks(panel, {"p": 5, "q": 7}).groupBy("block").count().collect()}
    assert sizes == {"p": 5, "q": 7}
    x = synth.sex_overlay(plan, panel).groupBy("gt").count().collect()
    assert {r.gt: r["count"] for r in x} == {"AA": 55 * 50, "AC": 45 * 50}


def test_gates_and_unions(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("", "y")], "participant_id string, country string")
    good, bad = filters.gated(df, ["participant_id", "country"])
    assert [r.participant_id for r in good.collect()] == ["a"]
    assert sorted(r.reason for r in bad.collect()) == ["missing country", "missing participant_id"]
    assert qc.union_reports([df, df.drop("country")]).count() == 6
    used, dropped = sinks.variant_audit(filters.joint_variants(spark.createDataFrame([(0.3, 0.0), (0.001, 0.5)], "allele_freq double, missing_rate double")))
    assert used.count() == 1 and dropped.first().reason == "allele_freq;missing_rate"
    assert counts.class_counts(spark.createDataFrame([(1, None)], "rsid long, dosage int"), "rsid").first()[1:] == (0, 0, 0, 1)


def test_archives(spark, matrix, tmp_path):
    d = long_dosages(spark, matrix).withColumn("sample_id", F.format_string("S%02d", "sample_id"))
    binary.write_npz(d, str(tmp_path / "a.npz"))
    want = {(r.sample_id, r.rsid, r.pos, r.dosage) for r in d.collect()}
    assert {(r.sample_id, r.rsid, r.pos, r.dosage) for r in binary.read_npz(spark, str(tmp_path / "a.npz")).collect()} == want
    np.save(tmp_path / "b.npy", np.array([[0, 255], [2, 1]], np.uint8))
    got = {tuple(r) for r in binary.read_npy(spark, str(tmp_path / "b.npy"), ["x", "y"], ["rs1", "rs2"]).collect()}
    assert got == {("x", "rs1", 0), ("x", "rs2", None), ("y", "rs1", 2), ("y", "rs2", 1)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("deep/data.tsv", "a\tb\n1\t2\n")
    assert [r.line for r in binary.zip_lines(spark, str(tmp_path / "z.zip"), "data.tsv").orderBy("line_number").collect()] == ["a\tb", "1\t2"]
    assert binary.zip_lines(spark, str(tmp_path / "z.zip"), "other").count() == 0
    con = sqlite3.connect(tmp_path / "m.sqlite")
    con.execute("CREATE TABLE rsid_reference (chrom TEXT, pos INTEGER, rsid TEXT)")
    con.executemany("INSERT INTO rsid_reference VALUES (?, ?, ?)", [("1", 5, "7"), ("1", 6, "rs1"), ("1", 6, "rs2")])
    con.commit()
    assert [tuple(r) for r in binary.sqlite_locus_map(spark, str(tmp_path / "m.sqlite")).collect()] == [("1", 5, "rs7")]


def test_snp_positions(spark):
    rows = [("p", "f", k, x) for k, x in enumerate(["Name\tChr\tPosition", "a\t1\t5", "a\t1\t6", "b\tX\tz"], 1)]
    got = text.snp_positions(spark.createDataFrame(rows, "participant_id string, file string, line_number int, line string"))
    assert {tuple(r) for r in got.collect()} == {("a", "1", 5), ("b", "X", None)}
