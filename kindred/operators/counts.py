"""Allele and genotype counts, frequencies, and dosages. Genotypes are long: a row a sample and variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..params import DEFAULT

BASES = "ACGT"


def usable(g: DataFrame, min_gs: float = DEFAULT.min_gs) -> DataFrame:
    """Rows with a SNP call and a GenCall score of ``min_gs`` at least; a missing score counts as 1."""
    return g.where((F.coalesce("gs", F.lit(1.0)) >= min_gs) & G.is_snp(F.col("gt")))


def with_dosage(g: DataFrame, min_gs: float = DEFAULT.min_gs) -> DataFrame:
    """``dosage`` of the alternate allele; null for a low score, a no-call or a foreign allele."""
    good = F.coalesce("gs", F.lit(1.0)) >= min_gs
    return g.withColumn("dosage", F.when(good, G.alt_dosage(F.col("gt"), F.col("ref"), F.col("alt"))))


def allele_counts(g: DataFrame, *by: str) -> DataFrame:
    """``n_A, n_C, n_G, n_T`` over the SNP calls of each variant, in one aggregation without a row an allele."""

    def n(base: str) -> Column:
        one = (F.substring("gt", 1, 1) == base).cast("int") + (F.substring("gt", 2, 1) == base).cast("int")
        return F.coalesce(F.sum(F.when(G.is_snp(F.col("gt")), one)), F.lit(0)).alias(f"n_{base}")

    return g.groupBy(*by).agg(*map(n, BASES))


def biallelic(counts: DataFrame, prefix: str = "n") -> DataFrame:
    """Variants with one or two alleles: ``major`` and ``minor`` by count, ties in the order A, C, G, T.

    A variant of one allele has it as both. Counts are in ``<prefix>_A`` and so on.
    """
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-F.col(f"{prefix}_{b}")).alias("less"), F.lit(b).alias("base")) for b in BASES)), lambda s: s["less"] < 0))
    found = counts.withColumn("ranked", ranked).where(F.size("ranked").between(1, 2))
    return found.select("*", F.get("ranked", F.lit(0))["base"].alias("major"), F.element_at("ranked", -1)["base"].alias("minor")).drop("ranked")


def minor_dosage(g: DataFrame, variants: DataFrame, key: str = "rsid") -> DataFrame:
    """``dosage`` of the inferred minor allele by sample and variant."""
    return g.join(variants.select(key, "major", "minor"), key).withColumn("dosage", G.alt_dosage(F.col("gt"), F.col("major"), F.col("minor")))


def oriented(g: DataFrame, key: str = "rsid") -> DataFrame:
    """``a1`` (less common) and ``a2`` (more common) of each variant; in a tie the first sample's first allele is a2.

    A variant of one allele has it as a2, and 0 as a1.
    """
    ranked = biallelic(allele_counts(g, key))
    anchor = g.where(G.is_snp(F.col("gt"))).groupBy(key).agg(F.min_by(F.substring("gt", 1, 1), "sample_id").alias("anchor"))
    counts = [F.when(F.col(side) == b, F.col(f"n_{b}")) for side in ("major", "minor") for b in BASES]
    tie = F.coalesce(*counts[:4]) == F.coalesce(*counts[4:])
    swap = tie & (F.col("anchor") == F.col("minor"))
    return ranked.join(anchor, key).select(key, F.when(F.col("major") == F.col("minor"), "0").when(swap, F.col("major")).otherwise(F.col("minor")).alias("a1"), F.when(swap, F.col("minor")).otherwise(F.col("major")).alias("a2"))


def class_counts(d: DataFrame, *by: str) -> DataFrame:
    """Counts of dosage 0, 1, 2 and of nulls."""
    return d.groupBy(*by).agg(
        F.count_if(F.col("dosage") == 0).alias("n_homref"),
        F.count_if(F.col("dosage") == 1).alias("n_het"),
        F.count_if(F.col("dosage") == 2).alias("n_homalt"),
        F.count_if(F.col("dosage").isNull()).alias("n_missing"),
    )


def allele_stats(d: DataFrame, samples: int, *by: str) -> DataFrame:
    """Allele number, frequency and missing rate by variant, of ``samples`` samples whether or not they have a row."""
    called = F.count("dosage")
    return d.groupBy(*by).agg(
        (2 * called).alias("allele_number"), (F.sum("dosage") / F.nullif(2 * called, F.lit(0))).alias("allele_freq"), (1 - called / F.lit(samples)).alias("missing_rate")
    )


def population_af(g: DataFrame, min_gs: float = DEFAULT.min_gs) -> DataFrame:
    """``(pop, locus_key, rsid, allele_freq, allele_number)`` on loci that are biallelic in the whole cohort.

    Reference and alternate are the two alleles in the order of the alphabet, so all populations agree; loci without a
    call in a population have no row there. The universe of loci is every sample's. Calls are scanned and aggregated
    once; the cohort's totals are a window over the few rows of each variant.
    """
    calls = usable(g, min_gs)
    by = ["rsid", "chrom", "pos"]
    totals = {f"all_{b}": F.sum(f"n_{b}").over(Window.partitionBy(*by)) for b in BASES}
    own = biallelic(allele_counts(calls, "pop", *by).withColumns(totals), "all").where("major <> minor")
    own = own.withColumns({"r": F.least("major", "minor"), "a": F.greatest("major", "minor")})
    ac = F.coalesce(*(F.when(F.col("a") == b, F.col(f"n_{b}")) for b in BASES))
    an = sum(F.col(f"n_{b}") for b in BASES)
    return own.where(an > 0).select("pop", G.locus_key(F.col("chrom"), F.col("pos"), F.col("r"), F.col("a")).alias("locus_key"), "rsid", (ac / an).alias("allele_freq"), an.alias("allele_number"))


def group_af(d: DataFrame, groups: dict[str, list[str]], label: str = "pop") -> DataFrame:
    """``(grp, rsid, ac, an, af)`` where a group is a set of labels; groups may share labels."""
    member = F.array_compact(F.array(*(F.when(F.col(label).isin(labels), F.lit(name)) for name, labels in groups.items())))
    rows = d.select("rsid", "dosage", F.explode(member).alias("grp"))
    return rows.groupBy("grp", "rsid").agg(F.coalesce(F.sum("dosage"), F.lit(0)).alias("ac"), (2 * F.count("dosage")).alias("an")).withColumn("af", F.col("ac") / F.nullif(F.col("an"), F.lit(0)))


def dosage_histogram(d: DataFrame) -> DataFrame:
    """One row on a whole matrix: cells, missing rate, and how many of each dosage."""
    return d.agg(
        F.count("*").alias("cells"),
        F.bround(F.count_if(F.col("dosage").isNull()) / F.nullif(F.count("*"), F.lit(0)), 6).alias("missing_rate"),
        *(F.count_if(F.col("dosage") == k).alias(f"dosage_{k}") for k in range(3)),
    )
