"""Byte ranges of plain, gzipped and block-gzipped files; scans with bad files among good ones; VCF as callers write it."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import labels as L
from kindred.operators import counts
from kindred.sources import discovery, ranges, tables, text, vcf


def bodies():
    rng = random.Random(2)
    for t in range(24):
        n = rng.choice([0, 1, 3, 200, 3000])
        lines = ["".join(rng.choice("abcé\t") for _ in range(rng.choice([0, 1, 5, 80]))).encode() for _ in range(n)]
        if t % 7 == 0 and n:
            lines[n // 2] = b"x" * 200_000
        yield b"\n".join(lines) + (b"\n" if t % 2 and n else b"")


@pytest.mark.parametrize("kind", ["plain", "blocks", "stream", "members"])
def test_every_line_is_in_one_range(tmp_path, kind):
    for t, body in enumerate(bodies()):
        half = len(body) // 2
        data = {"plain": body, "blocks": ranges.pack_blocks(body), "stream": gzip.compress(body), "members": gzip.compress(body[:half]) + gzip.compress(body[half:])}[kind]
        (path := tmp_path / f"{t}").write_bytes(data)
        want = body.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        for step in (1000, 7777, 70_000, 1 << 25):
            if len(data) // step > 400:
                continue
            parts = ranges.RangeReader({"files": ranges.json.dumps([(str(path), len(data))]), "range_bytes": str(step)}).partitions()
            assert [x for p in parts for some in ranges.lines_of(p) for x in some] == want


def test_blocks_are_gzip(tmp_path):
    body = b"line\n" * 50_000
    assert gzip.decompress(ranges.pack_blocks(body)) == body


def test_numbers_on_a_file_of_many_splits(spark, tmp_path):
    want = [f"line {k} é" for k in range(30_000)]
    (tmp_path / "a.txt").write_text("\r\n".join(want))
    (tmp_path / "b.txt.gz").write_bytes(ranges.pack_blocks("\n".join(want).encode()))
    files = ranges.listed(str(tmp_path))
    rows = ranges.numbered_lines(spark, files, 10_000)
    assert ranges.line_ranges(spark, files, 10_000).rdd.getNumPartitions() > 40
    for name in ("a.txt", "b.txt.gz"):
        got = sorted((r.line_number, r.line) for r in rows.where(F.col("file").endswith(name)).collect())
        assert got == list(enumerate(want, 1))
    tasks = ranges.line_ranges(spark, files, 10_000).where("file like '%.gz'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 2


def test_a_bad_file_fails_alone(spark, tmp_path):
    good = "rsid\tchrom\tpos\tgt\tgs\tbaf\tlrr\n" + "".join(f"rs{k}\t1\t{k + 1}\tAG\t1\t1\t1\n" for k in range(5000))
    for name in ("p1", "p2/deep", "p3"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "top.txt").write_text(good)
    (tmp_path / "p1/a.txt").write_text(good)
    (tmp_path / "p2/deep/a.txt").write_bytes(b"")
    cut = gzip.compress(good.encode())
    (tmp_path / "p3/cut.txt").write_bytes(cut[: len(cut) // 2])
    blocks = ranges.pack_blocks(good.encode())
    (tmp_path / "p3/blocks.txt").write_bytes(blocks[: len(blocks) - 3000])
    sheet = spark.createDataFrame([("s1", str(tmp_path / "p1/a.txt")), ("s2", str(tmp_path / "p1")), ("s3", str(tmp_path / "no.txt"))], "participant_id string, path string")
    found = discovery.inputs(spark, [str(tmp_path), str(tmp_path / "absent.txt"), str(tmp_path / "p1/a.txt")], sheet)
    names = {(r.participant_id, r.file.rsplit("/", 1)[1]) for r in found.collect()}
    assert {("top", "top.txt"), ("p1", "a.txt"), ("deep", "a.txt"), ("p3", "cut.txt"), ("absent", "absent.txt"), ("a", "a.txt"), ("s2", "p1")} <= names
    lines, issues = discovery.scan(spark, found, 9000)
    codes = {(r.participant_id, r.file.rsplit("/", 1)[1], r.code, r.line_number) for r in issues.collect()}
    assert codes == {
        ("absent", "absent.txt", "FILE_NOT_FOUND", 0), ("s3", "no.txt", "FILE_NOT_FOUND", 0), ("s2", "p1", "NOT_A_FILE", 0), ("deep", "a.txt", "FILE_EMPTY", 0),
        ("p3", "cut.txt", "READ_EXCEPTION", 0), ("p3", "blocks.txt", "READ_EXCEPTION", 0),
    }
    n = {(r.participant_id, r.name): (r.n, r.last) for r in lines.groupBy("participant_id", F.element_at(F.split("file", "/"), -1).alias("name")).agg(F.count("*").alias("n"), F.max("line_number").alias("last")).collect()}
    assert n["top", "top.txt"] == n["p1", "a.txt"] == n["s1", "a.txt"] == n["a", "a.txt"] == (5001, 5001)
    assert 0 < n["p3", "cut.txt"][0] < 5001
    none, issues = discovery.scan(spark, discovery.inputs(spark, []))
    assert none.count() == issues.count() == 0


HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"
SITES = [
    "chr1\t10\trs1\ta\tg\t.\t.\t.\tGT\t0/1\t1|1", "chrM\t11\t.\tC\tT\t.\t.\t.\tDP:GT\t7:0/0\t8:./.", "2\t12\trs3\tA\tG\t.\t.\t.\tGT\t0/1", "2\t13\trs4\tA\tG,T\t.\t.\t.\tGT\t0/1\t0/1",
    "2\t14\trs5\tAC\tG\t.\t.\t.\tGT\t0/1\t0/1", "2\tx\trs6\tA\tG\t.\t.\t.\tGT\t0/1\t0/1", "3\t15\trs7\tN\tG\t.\t.\t.\tGT\t0/1\t0/1", "X\t16\trs8\tT\tc\t.\t.\t.\tGT\t1\t0/1\tmore",
]


def test_vcf_as_callers_write_it(spark, tmp_path):
    for k, name in enumerate(("a.vcf", "b.vcf.gz")):
        body = "\n".join([HEAD, *SITES]).replace("rs", f"rs{k}").encode()
        (tmp_path / name).write_bytes(ranges.pack_blocks(body) if k else body)
    loci = spark.createDataFrame([("1", 10, "rs99"), ("chrM", 11, "rs5"), ("X", 16, "rs6"), ("X", 16, "rs7")], "chrom string, pos long, rsid string")
    got = sorted(tuple(r) for r in vcf.read_vcf(spark, str(tmp_path), loci, range_bytes=40).drop("gt").collect())
    want = [("S1", "1", 10, "rs99", "A", "G", 1), ("S2", "1", 10, "rs99", "A", "G", 2), ("S1", "MT", 11, "rs5", "C", "T", 0), ("S2", "MT", 11, "rs5", "C", "T", None)]
    assert sorted(got, key=str) == sorted([*want * 2, *(x for k in (0, 1) for x in (("S1", "X", 16, f"rs{k}8", "T", "C", None), ("S2", "X", 16, f"rs{k}8", "T", "C", 1)))], key=str)
    (tmp_path / "c.vcf").write_text(HEAD.replace("S1\tS2", "S2\tS1"))
    with pytest.raises(ValueError, match="differs"):
        vcf.read_vcf(spark, str(tmp_path))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.vcf").write_text("##x\nno header\n")
    with pytest.raises(ValueError, match="no header"):
        vcf.read_vcf(spark, str(tmp_path / "d"))
    (tmp_path / "d/x.vcf").write_bytes(gzip.compress("\n".join([HEAD, *SITES * 50]).encode())[:-20])
    with pytest.raises(Exception, match="EOFError"):
        vcf.read_vcf(spark, str(tmp_path / "d")).collect()


def test_simple_tables_need_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿# note\nID,"chr",Position,GT\nrs1,chr1,5,a/g\n"rs2",2,6,"AG"\nrs3,2,-1,AG\nrs4\n')
    got = {(r.rsid, r.chrom, r.pos, r.gt) for r in text.simple_table(spark, str(tmp_path / "a.csv")).collect()}
    assert ("rs2", "2", 6, "AG") in got and not {r for r in got if r[0] in ("rs3", "rs4")}
    (tmp_path / "b.csv").write_text("ID,chr,GT\nrs1,1,AG\n")
    with pytest.raises(Exception, match="no column for pos"):
        text.simple_table(spark, str(tmp_path / "b.csv")).collect()


def test_first_row_of_a_file_counts(spark):
    rows = [(1, "1:5:A:G", "0.9", "10"), (2, "chr1-5-a-g", "0.2", "40"), (3, "1:6:A:G", "0.1", "x"), (4, "1:7:A:G", "0.1", "4"), (5, "bad", "0.1", "4"), (6, "1:8:C:T", None, "6")]
    af = spark.createDataFrame(rows, "line_number long, locus_key string, allele_freq string, allele_number string")
    v = spark.createDataFrame([("1", p, r, a) for p, r, a in ((5, "A", "G"), (6, "A", "G"), (8, "C", "T"), (9, "C", "T"))], "chrom string, pos long, ref string, alt string")
    out, stats = tables.keyed_af(af, v)
    assert {r.pos: (r.allele_freq, r.allele_number) for r in out.collect()} == {5: (0.9, 10), 6: (None, 0), 8: (None, 6), 9: (None, 0)}
    assert tuple(stats.first()) == (6, 2, 3, 1)


def test_monomorphic_variants_have_no_second_allele(spark):
    g = spark.createDataFrame([(1, "rs1", "AA"), (2, "rs1", "AA"), (1, "rs2", "AG"), (2, "rs2", "GG")], "sample_id int, rsid string, gt string")
    assert {(r.rsid, r.a1, r.a2) for r in counts.oriented(g).collect()} == {("rs1", "0", "A"), ("rs2", "A", "G")}


@pytest.mark.parametrize(
    ("call", "want"),
    [("no call", True), (" NA ", True), ("n/a", True), ("None", True), ("", False), (None, False), ("b (Reference)/B  (reference)", True), ("rs1 reference (a)/rs1 reference (g)", True), ("*1/*1", True), ("*1/*10", False), ("ref/ref", False), ("*1/*1 (0.9)", False)],
)
def test_reference_like(spark, call, want):
    assert spark.createDataFrame([(call,)], "c string").select(L.reference_like(F.col("c"))).first()[0] is want


def test_raw_alleles(spark):
    sites = [("chr10", 5, "A", "G", "0/1"), ("chr2", 9, "A", "G, T", "./."), ("2", 9, "A", "C,T", "1|2"), ("MT", 1, "A", "G", "1"), ("X", 1, "A", "G", "1/1"), ("GL1", 1, "A", "G", "2/1"), ("1", 1, "A", "G", "0/0"), ("1", 1, "A", "", "0/1"), ("1", 1, "A", "G", None)]
    df = spark.createDataFrame([(sites,)], "v array<struct<chrom:string,pos:long,ref:string,alt:string,gt:string>>")
    got = df.select(L.raw_allele_tokens(F.col("v"))).first()[0]
    assert got == "2:9:A>C=1|0;chr2:9:A>G=./.;2:9:A>T=0|1;chr2:9:A>T=./.;chr10:5:A>G=0/1;X:1:A>G=1/1;MT:1:A>G=1;GL1:1:A>G=0/1"
    keys = spark.createDataFrame([("DP:GT", "7:0/1"), ("DP", "7"), ("DP:GT", "7"), ("GT", None)], "k string, v string")
    assert [r[0] for r in keys.select(L.sample_genotype(F.col("k"), F.col("v"))).collect()] == ["0/1", "7", "7", ""]
