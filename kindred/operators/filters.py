"""Sample and variant filters, each with the reasons for what it drops."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..params import DEFAULT, Params
from .counts import class_counts


def sample_missingness(d: DataFrame, variants: int) -> DataFrame:
    """``(sample_id, n_missing, missing_rate)`` of ``variants`` variants; a pair without a row is missing."""
    return d.groupBy("sample_id").agg((F.lit(variants) - F.count("dosage")).alias("n_missing")).withColumn("missing_rate", F.col("n_missing") / F.lit(variants))


def hwe_chi2(hom: Column, het: Column, alt: Column) -> Column:
    """Chi-square of Hardy-Weinberg proportions; null, which passes, if a class is hardly expected."""
    n = hom + het + alt
    q = (2 * alt + het) / F.nullif(2 * n, F.lit(0))
    expected = [n * (1 - q) * (1 - q), n * 2 * (1 - q) * q, n * q * q]
    terms = [(o - e) * (o - e) / F.nullif(e, F.lit(0.0)) for o, e in zip((hom, het, alt), expected, strict=True)]
    return F.when(F.least(*expected) >= 1e-6, terms[0] + terms[1] + terms[2])


def variant_qc(d: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Counts of each variant over samples within ``mind``, with ``filter``: call_rate, maf, hwe or pass, the first that fails.

    Samples go first, so that variants are judged on those that stay. The grid of pairs is never made: a pair without a
    row counts as missing by arithmetic.
    """
    sizes = d.agg(F.count_distinct("rsid").alias("variants")).first()
    kept = sample_missingness(d, sizes["variants"]).where(F.col("missing_rate") <= p.mind).select("sample_id")
    samples = kept.count()
    return label_variants(class_counts(d.join(kept, "sample_id", "left_semi"), "rsid", "chrom", "pos"), samples, p)


def label_variants(counts: DataFrame, samples: int, p: Params = DEFAULT) -> DataFrame:
    called = F.col("n_homref") + F.col("n_het") + F.col("n_homalt")
    q = (2 * F.col("n_homalt") + F.col("n_het")) / F.nullif(2 * called, F.lit(0))
    rows = counts.withColumns({"n_missing": F.lit(samples) - called, "call_rate": called / F.nullif(F.lit(samples), F.lit(0)), "maf": F.coalesce(F.least(q, 1 - q), F.lit(0.0))})
    rows = rows.withColumn("chi2", hwe_chi2(F.col("n_homref"), F.col("n_het"), F.col("n_homalt")))
    reason = F.when(1 - F.col("call_rate") > p.geno, "call_rate").when(F.col("maf") < p.maf, "maf").when(F.col("chi2") > p.hwe_chi2, "hwe").otherwise("pass")
    return rows.withColumn("filter", reason)


def all_reasons(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``reasons``: GENO, MAF and HWE as far as they fail, joined by commas."""
    return rows.withColumn(
        "reasons", F.concat_ws(",", F.when(1 - F.col("call_rate") > p.geno, "GENO"), F.when(F.col("maf") < p.maf, "MAF"), F.when(F.col("chi2") > p.hwe_chi2, "HWE"))
    )


def dropped_with_reasons(rows: DataFrame, survivors: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows of variants that aren't among ``survivors (rsid)``, with ``reasons``; OTHER where none of the thresholds explains it."""
    gone = all_reasons(rows, p).join(survivors.select("rsid").distinct(), "rsid", "left_anti")
    return gone.withColumn("reasons", F.when(F.col("reasons") == "", "OTHER").otherwise(F.col("reasons")))


def hwe_exact_p(het: int, hom1: int, hom2: int) -> float:
    """The exact test's p-value: the probability of heterozygote counts no likelier than the one seen."""
    rare, n = 2 * min(hom1, hom2) + het, het + hom1 + hom2
    if not n:
        return 1.0
    log = [0.0]
    # Ratios of neighbours P(h + 2) / P(h), walked from the least count up.
    for h in range(rare % 2, rare - 1, 2):
        r, c = (rare - h) // 2, n - (rare - h) // 2 - h
        log.append(log[-1] + math.log(4 * r * c / ((h + 2) * (h + 1))))
    top = max(log)
    weights = [math.exp(x - top) for x in log]
    seen = weights[(het - rare % 2) // 2]
    return min(1.0, sum(w for w in weights if w <= seen * (1 + 1e-9)) / sum(weights))


def hwe_exact(counts: DataFrame) -> DataFrame:
    """``hwe_exact`` beside ``n_homref, n_het, n_homalt``; computed once for each distinct triple."""

    @F.pandas_udf("double")
    def p(het: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([hwe_exact_p(int(x), int(y), int(z)) for x, y, z in zip(het, a, b, strict=True)])

    by = ["n_homref", "n_het", "n_homalt"]
    return counts.join(counts.select(*by).distinct().withColumn("hwe_exact", p("n_het", "n_homref", "n_homalt")), by)


def chi2_p(chi2: Column) -> Column:
    """The p-value of a chi-square with one degree of freedom, for audit tables; 1 for a null."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 1.0 if pd.isna(v) else math.erfc(math.sqrt(v / 2)))

    return tail(chi2)


def joint_variants(stats: DataFrame, min_af: float = 0.01, max_missing: float = 0.05) -> DataFrame:
    """``stage`` of each variant of a joint analysis: used, or dropped with ``reason``."""
    reason = F.concat_ws(
        ";", F.when(F.col("allele_freq").isNull(), "no_calls"), F.when((F.col("allele_freq") < min_af) | (F.col("allele_freq") > 1 - min_af), "allele_freq"), F.when(F.col("missing_rate") > max_missing, "missing_rate")
    )
    return stats.withColumn("reason", reason).withColumn("stage", F.when(F.col("reason") == "", "used").otherwise("dropped"))


def pca_prefilter(variants: DataFrame, locus_map: DataFrame) -> DataFrame:
    """``reasons`` against a variant in a PCA: bad_alleles, monomorphic, off_map, repeated_rsid; empty if it is used.

    ``variants (rsid, chrom, pos, a1, a2)``; a variant is on the map by its rsid or by its locus.
    """
    ids = locus_map.select("rsid").distinct().withColumn("by_id", F.lit(True))
    loci = locus_map.select("chrom", "pos").distinct().withColumn("by_locus", F.lit(True))
    first = F.row_number().over(Window.partitionBy("rsid").orderBy("chrom", "pos", "a1", "a2"))
    valid = F.col("a1").rlike("^[ACGT]$") & F.col("a2").rlike("^[ACGT]$")
    rows = variants.join(ids, "rsid", "left").join(loci, ["chrom", "pos"], "left").withColumn("nth", first)
    reasons = F.concat_ws(
        ";",
        F.when(~valid, "bad_alleles"),
        F.when(valid & (F.col("a1") == F.col("a2")), "monomorphic"),
        F.when(~F.coalesce("by_id", "by_locus", F.lit(False)), "off_map"),
        F.when(F.col("nth") > 1, "repeated_rsid"),
    )
    return rows.select("rsid", "chrom", "pos", "a1", "a2", reasons.alias("reasons"))


def unambiguous(variants: DataFrame) -> DataFrame:
    """Without the strand-ambiguous pairs A/T and C/G."""
    return variants.where(~G.ambiguous(F.col("ref"), F.col("alt")))


def enough_overlap(d: DataFrame, loadings: DataFrame, least: float = 0.95) -> DataFrame:
    """``(sample_id, observed, kept)``: whether a sample has calls at ``least`` of the loadings' variants."""
    total = loadings.select("rsid").distinct()
    needed = math.ceil(total.count() * least)
    seen = d.where("dosage is not null").join(total, "rsid", "left_semi").groupBy("sample_id").agg(F.count("*").alias("observed"))
    return seen.withColumn("kept", F.col("observed") >= needed)


def in_range(g: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of a genomic range, ends included."""
    return g.where((G.clean_chrom(F.col("chrom")) == chrom) & F.col("pos").between(start, end))


def subsample(g: DataFrame, modulus: int = 14) -> DataFrame:
    """Rows with an rs number divisible by ``modulus``."""
    return g.where(F.col("rsid").rlike("(?i)^rs[0-9]{1,18}$") & (F.substring("rsid", 3, 30).try_cast("bigint") % modulus == 0))


def founders(panel: DataFrame) -> DataFrame:
    """Samples without a father or mother in the panel."""
    return panel.where((F.coalesce("father_id", F.lit("0")) == "0") & (F.coalesce("mother_id", F.lit("0")) == "0"))


def gated(rows: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all ``needed`` fields, and the others with ``reason``."""
    lacks = F.concat_ws(";", *(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing {c}") for c in needed))
    marked = rows.withColumn("reason", lacks)
    return marked.where("reason = ''").drop("reason"), marked.where("reason <> ''")


def dropped(before: DataFrame, after: DataFrame, key: str = "rsid") -> DataFrame:
    """An audit: what went in and did not come out."""
    return before.join(after, key, "left_anti")
