"""Joins of study calls with panels, loadings and lists of samples or variants.

Panels, loadings and lists are much smaller than the calls; Spark broadcasts them where their size allows, and else
shuffles both sides by locus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..sources.shared import written
from .popgen import first_by

LOCUS = ["chrom", "pos"]


def fits(gt: Column, ref: Column, alt: Column) -> Column:
    """Whether a genotype of two letters has no allele but ``ref`` and ``alt``."""
    return (F.length(gt) == 2) & F.substring(gt, 1, 1).isin(ref, alt) & F.substring(gt, 2, 1).isin(ref, alt)


def alts(gt: Column, alt: Column) -> Column:
    return (F.substring(gt, 1, 1) == alt).cast("int") + (F.substring(gt, 2, 1) == alt).cast("int")


def nth_in_file(last: bool = False) -> Column:
    """The number of a row among those of its sample and locus, in file order or from the end."""
    order = F.col("line_number").desc() if last else F.col("line_number")
    return F.row_number().over(Window.partitionBy("sample_id", *LOCUS).orderBy(order))


def panel_dosages(calls: DataFrame, panel: DataFrame) -> DataFrame:
    """``(sample_id, chrom, pos, ref, alt, dosage)`` of ``calls (sample_id, line_number, chrom, pos, gt)`` at a panel's loci.

    A sample's first row at a locus decides, also if its alleles aren't the panel's: the dosage is then missing, and no
    later row is looked at. Of panel rows at one locus the last by ref and alt counts.
    """
    sites = panel.groupBy(*LOCUS).agg(F.max(F.struct("ref", "alt")).alias("x")).select(*LOCUS, "x.*")
    first = calls.groupBy("sample_id", *LOCUS).agg(F.min_by("gt", F.struct("line_number")).alias("gt"))  # most rows fall away before the shuffle
    rows = first.join(sites, LOCUS)
    gt, ref, alt = F.col("gt"), F.col("ref"), F.col("alt")
    return rows.select("sample_id", *LOCUS, "ref", "alt", F.when(fits(gt, ref, alt), alts(gt, alt)).alias("dosage"))


def loading_dosages(calls: DataFrame, loadings: DataFrame, least_score: float = 0.15) -> DataFrame:
    """Dosages of calls at the loci of ``loadings (chrom, pos, ref, alt, ...)``, with the loadings' other columns.

    Only autosomal calls of two letters and a score of ``least_score`` or more (none: 1) count. A call whose alleles aren't
    the loading's is missing, that is no row; of several that fit a sample's last counts.
    """
    score = F.coalesce(F.nanvl("gs", F.lit(None).cast("double")), F.lit(1.0))
    rows = calls.where(F.col("chrom").isin(G.AUTOSOMES) & (score >= least_score) & (F.length("gt") == 2)).join(loadings, LOCUS)
    gt, ref, alt = F.col("gt"), F.col("ref"), F.col("alt")
    rows = rows.where(fits(gt, ref, alt)).withColumn("nth", nth_in_file(last=True)).where("nth = 1")
    return rows.select("sample_id", *loadings.columns, alts(gt, alt).alias("dosage"))


def allele_matched(variants: DataFrame, loadings: DataFrame) -> DataFrame:
    """Study variants ``(chrom, pos, a1, a2, ...)`` with the loadings whose ref is A2 and alt is A1, and 0 < AF < 1."""
    own = variants.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    theirs = loadings.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).where("pca_af > 0 and pca_af < 1")
    keyed = own.withColumnsRenamed({"a2": "ref", "a1": "alt"})
    return keyed.join(theirs, [*LOCUS, "ref", "alt"])


def keyed_slices(keymap: DataFrame, slices: DataFrame) -> DataFrame:
    """``locus_key`` of every row of a key map, with the frequencies of ``slices (locus_key, ...)`` or nulls."""
    return keymap.select("locus_key").join(slices, "locus_key", "left")


def subset(d: DataFrame, keep: DataFrame | None = None, remove: DataFrame | None = None, extract: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows of the samples in ``keep`` and not in ``remove`` (``sample_id``), at the variants in ``extract`` and not in ``exclude`` (``rsid``)."""
    for listed, key, how in ((keep, "sample_id", "left_semi"), (remove, "sample_id", "left_anti"), (extract, "rsid", "left_semi"), (exclude, "rsid", "left_anti")):
        if listed is not None:
            d = d.join(listed.select(key).distinct(), key, how)
    return d


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Compartments of the same samples at different variants as one table; others are an error."""
    parts = [written(p) for p in parts]  # each is read several times
    samples = [p.select("sample_id").distinct() for p in parts]
    for other in samples[1:]:
        if samples[0].exceptAll(other).unionAll(other.exceptAll(samples[0])).head(1):
            raise ValueError("the compartments have different samples")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    shared = parts[0].select("rsid").distinct().withColumn("part", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        shared = shared.unionByName(p.select("rsid").distinct().withColumn("part", F.lit(n)))
    if shared.groupBy("rsid").count().where("count > 1").head(1):
        raise ValueError("the compartments share variants")
    return out


def first_slices(rows: DataFrame) -> DataFrame:
    """The first row of each ``locus_key`` in order of file and place in it."""
    return first_by(rows, ["locus_key"], ["file", "block", "nth"]).drop("file", "block", "nth")
