"""VCF text as long dosages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators.popgen import unambiguous_map
from .ranges import RANGE_BYTES, Range, line_ranges, lines_of, listed
from .shared import written


#: Loci of a map that are broadcast at most.
MOST_LOCI = 1_000_000


def sample_lists(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``(file, samples)``: the names in each file's header line; null without one. A file is read up to that line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [header(path, size) for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["file", "samples"])

    named = spark.createDataFrame(files, "file string, bytes long").repartition(max(1, min(len(files), 200)), "file")
    return named.mapInArrow(run, "file string, samples array<string>")


def header(path: str, size: int) -> list[str] | None:
    for lines in lines_of(Range(path, 0, 0, size)):
        for line in lines:
            if line.startswith(b"#CHROM"):
                return line.decode("utf-8", "replace").rstrip("\r").split("\t")[9:]
            if not line.startswith(b"#"):
                return None
    return None


def read_vcf(spark: SparkSession, path: str, loci: DataFrame | None = None, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(sample_id, chrom, pos, rsid, ref, alt, gt, dosage)`` of the biallelic A/C/G/T sites of a file or folder.

    Plain and block-gzipped files are read by ranges, many tasks a file. Alleles are put in capitals first; chromosomes
    lose a leading chr, and M is MT. A site that the map ``loci (chrom, pos, rsid)`` names without contradiction takes its
    rsid from there. Lines with fewer columns than the header has samples, sites with several alternates or longer
    alleles, and lines without a whole position are left out; further columns are ignored. All files must list the same
    samples in the same order: else, and without a header or if a file can't be read to its end, it is an error.
    """
    files = listed(path, glob)
    heads = written(sample_lists(spark, files))
    kinds = heads.groupBy(F.sha2(F.to_json("samples"), 256).alias("kind")).agg(F.min("file").alias("file")).orderBy("file").limit(2).collect()
    if not kinds or any(k["kind"] is None for k in kinds):
        raise ValueError(f"{kinds[0]['file'] if kinds else path}: no header")
    if len(kinds) > 1:
        raise ValueError(f"{kinds[1]['file']}: sample list or order differs from {kinds[0]['file']}")
    # One row of names, no longer than any line of the files that a task holds anyway.
    samples = F.broadcast(heads.where(F.col("file") == kinds[0]["file"]).select("samples").limit(1))

    lines = line_ranges(spark, files, range_bytes)
    lines = lines.select(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "file", "problem"))).otherwise(F.regexp_replace("line", "\r$", "")).alias("value"))
    sites = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p")).join(samples)
    at = lambda k: F.get("p", F.lit(k))
    fields = F.split(at(8), ":")
    gt_at = F.when(F.array_position(fields, "GT") > 0, F.array_position(fields, "GT")).otherwise(1).cast("int")
    sites = sites.where(F.size("p") >= 9 + F.size("samples")).select(
        G.panel_chrom(at(0)).alias("chrom"), at(1).try_cast("long").alias("pos"), at(2).alias("rsid"), F.upper(at(3)).alias("ref"), F.upper(at(4)).alias("alt"), gt_at.alias("gt_at"),
        F.arrays_zip("samples", F.slice("p", F.lit(10), F.size("samples")).alias("gt")).alias("calls"),
    ).where(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$") & F.col("pos").isNotNull())
    if loci is not None:
        known = unambiguous_map(loci.withColumn("chrom", G.panel_chrom(F.col("chrom")))).withColumnRenamed("rsid", "mapped")
        few = known.limit(MOST_LOCI + 1).count() <= MOST_LOCI
        sites = sites.join(F.broadcast(known) if few else known, ["chrom", "pos"], "left").withColumn("rsid", F.coalesce("mapped", "rsid"))
    rows = sites.select("chrom", "pos", "rsid", "ref", "alt", "gt_at", F.explode("calls").alias("x"))
    gt = F.coalesce(F.get(F.split("x.gt", ":"), F.col("gt_at") - 1), F.lit(""))
    return rows.select(F.col("x.samples").alias("sample_id"), "chrom", "pos", "rsid", "ref", "alt", gt.alias("gt"), G.vcf_dosage(gt).alias("dosage"))


#: Names of the chromosomes that callers take, as they are or after chr.
CANONICAL = r"^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y|MT|M)\t"


def canonical_lines(lines: DataFrame) -> DataFrame:
    """VCF lines ``(value, ...)`` that are headers or of a canonical chromosome."""
    return lines.where(F.col("value").startswith("#") | F.col("value").rlike(CANONICAL))


def write_vcf(d: DataFrame, path: str) -> None:
    """Long dosages as headed VCF text; a part file a partition of sites, each with its header."""
    import pandas as pd

    names = [r[0] for r in d.select("sample_id").distinct().orderBy("sample_id").collect()]  # samples, not calls
    call = F.when(F.col("dosage") == 0, "0/0").when(F.col("dosage") == 1, "0/1").when(F.col("dosage") == 2, "1/1").otherwise("./.")
    rows = d.groupBy("chrom", "pos", "rsid", "ref", "alt").agg(F.map_from_entries(F.collect_list(F.struct("sample_id", call.alias("c")))).alias("calls"))
    sites = rows.withColumn("rank", G.chrom_rank(F.col("chrom"))).repartitionByRange("rank", "pos").sortWithinPartitions("rank", "pos", "rsid")

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(map(str, names))
        for b in batches:
            lines = ["\t".join([r.chrom, str(r.pos), r.rsid, r.ref, r.alt, ".", "PASS", ".", "GT", *(dict(r.calls).get(s, "./.") for s in names)]) for r in b.itertuples()]
            if lines:
                yield pd.DataFrame({"value": [head, *lines] if head else lines})
                head = ""

    sites.select("chrom", "pos", "rsid", "ref", "alt", "calls").mapInPandas(text, "value string").write.mode("overwrite").text(path)
