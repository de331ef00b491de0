"""Column functions on genotype fields: identifiers, chromosomes, alleles, dosages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats.
AUTOSOMES = [str(k) for k in range(1, 23)]
CHROMOSOMES = [*AUTOSOMES, "X", "Y", "M", "MT"]
CHROMOSOMES_WITH_PAR = [*CHROMOSOMES, "XY"]
NO_CALL = "--"
NO_CALL_TOKENS = ["", "-", ".", "N", "0", "NA", "N/A", "#N/A"]
QC_NO_CALL_TOKENS = ["", "-", "--", ".", "0", "00", "N", "NN", "NA", "N/A", "#N/A"]
INDEL_GENOTYPES = ["--", "II", "ID", "DI", "DD"]
VENDOR_MISSING = ["#N/A", "#n/a"]
MISSING_FACETS = ["", "na", "n/a", "null", "none", "nan", "."]
PLINK_CODES = {"X": 23, "Y": 24, "XY": 25, "MT": 26, "M": 26}


def clean_chrom(c: Column) -> Column:
    """Without white space and a leading "chr" of any case, in capitals."""
    return F.upper(F.regexp_replace(F.trim(c), "(?i)^chr", ""))


def panel_chrom(c: Column) -> Column:
    """As ``clean_chrom``, with M as MT."""
    x = clean_chrom(c)
    return F.when(x == "M", "MT").otherwise(x)


def valid_chrom(c: Column) -> Column:
    return clean_chrom(c).isin(CHROMOSOMES_WITH_PAR)


def plink_chrom(c: Column) -> Column:
    """PLINK's number of a chromosome; null if it has none."""
    x = clean_chrom(c)
    out = F.when(x.rlike("^[0-9]{1,2}$"), x.try_cast("int"))
    for name, code in PLINK_CODES.items():
        out = F.when(x == name, code).otherwise(out)
    return out


def admixture_chrom(c: Column) -> Column:
    """An integer code for any chromosome; 1 for what is unknown."""
    x = clean_chrom(c)
    return F.when(x == "X", 23).when(x == "Y", 24).when(x.isin("M", "MT"), 26).when(x.rlike("^[0-9]{1,2}$"), x.try_cast("int")).otherwise(1)


def chrom_rank(c: Column) -> Column:
    """A sort key: numbers, then X, Y, and the rest."""
    return F.when(c.rlike("^[0-9]{1,6}$"), c.try_cast("int")).when(c == "X", 23).when(c == "Y", 24).otherwise(99)


def canonical_rsid(c: Column) -> Column:
    """Empty for blanks and dots; anything else begins with rs."""
    x = F.trim(c)
    return F.when(x.isin("", ".", "-"), "").when(F.lower(x).startswith("rs"), x).otherwise(F.concat(F.lit("rs"), x))


def extract_rsid(c: Column) -> Column:
    """The first rs number in a probe's name, or empty."""
    digits = F.regexp_extract(c, "(?i)rs([0-9]+)", 1)
    return F.when(digits == "", "").otherwise(F.concat(F.lit("rs"), digits))


def variant_id(rsid: Column, chrom: Column, pos: Column, mapped: Column | None = None) -> Column:
    """The mapped rsid of the locus, else the row's, else chrom:pos."""
    choices = [F.nullif(rsid, F.lit("")), F.concat_ws(":", chrom, pos.cast("string"))]
    return F.coalesce(*([F.nullif(mapped, F.lit(""))] if mapped is not None else []), *choices)


def genotype(c: Column) -> Column:
    """A genotype of one field, in capitals; no-calls as "--"."""
    x = F.upper(F.trim(c))
    return F.when(x.isin(NO_CALL_TOKENS) | x.rlike("^[-.N0]+$"), NO_CALL).otherwise(x)


def genotype_of(a1: Column, a2: Column) -> Column:
    """A genotype of two allele fields."""
    x, y = F.upper(F.trim(a1)), F.upper(F.trim(a2))
    return F.when(x.isin(NO_CALL_TOKENS) | y.isin(NO_CALL_TOKENS), NO_CALL).otherwise(F.concat(x, y))


def valid_genotype(c: Column) -> Column:
    x = F.upper(F.trim(c))
    return x.isin(INDEL_GENOTYPES) | x.rlike("^[ACGT]{2}$")


def genotype_class(c: Column) -> Column:
    """snp, indel, no_call or invalid."""
    x = F.upper(F.trim(c))
    return F.when(x.isin(QC_NO_CALL_TOKENS), "no_call").when(x.rlike("^[ACGT]{2}$"), "snp").when(x.rlike("^[ACGTID]{2}$"), "indel").otherwise("invalid")


def is_snp(c: Column) -> Column:
    return c.rlike("^[ACGT]{2}$")


def allele(c: Column, k: int) -> Column:
    """The first (1) or second (2) allele of a SNP genotype, else null."""
    return F.when(is_snp(c), F.substring(c, k, 1))


def allele_code(c: Column) -> Column:
    """0 for no allele, 1 to 4 for A, C, G and T."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, "ACGT")), c), F.lit(0)), F.lit(0)).cast("int")


def heterozygous(c: Column) -> Column:
    """Two different characters, neither of them 0."""
    return (F.length(c) == 2) & (F.substring(c, 1, 1) != F.substring(c, 2, 1)) & ~c.contains("0")


def signal(c: Column) -> Column:
    """1 heterozygous, 0 homozygous, null without a SNP call."""
    return F.when(is_snp(c), (F.substring(c, 1, 1) != F.substring(c, 2, 1)).cast("int"))


def alt_dosage(gt: Column, ref: Column, alt: Column) -> Column:
    """How many alleles are ``alt``; null if one is neither ``ref`` nor ``alt``."""
    a, b = F.substring(gt, 1, 1), F.substring(gt, 2, 1)
    known = is_snp(gt) & (a == ref) | (is_snp(gt) & (a == alt))
    known = known & ((b == ref) | (b == alt))
    return F.when(known, (a == alt).cast("int") + (b == alt).cast("int"))


def vcf_dosage(gt: Column) -> Column:
    """Alternate alleles of a diploid biallelic VCF genotype, else null."""
    field = F.split_part(gt, F.lit(":"), F.lit(1))
    parts = F.split(field, r"[/|]")
    called = (F.size(parts) == 2) & F.forall(parts, lambda p: p.isin("0", "1"))
    return F.when(called, F.aggregate(parts, F.lit(0), lambda acc, p: acc + (p == "1").cast("int")))


def enumerated_dosage(gt: Column) -> Column:
    """As ``vcf_dosage``, for bare genotypes spelt out one by one."""
    return F.when(gt.isin("0/0", "0|0"), 0).when(gt.isin("0/1", "0|1", "1/0", "1|0"), 1).when(gt.isin("1/1", "1|1"), 2)


def ambiguous(ref: Column, alt: Column) -> Column:
    """Whether the alleles are each other's complements."""
    return F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AT", "CG")


def locus_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("-", chrom, pos.cast("string"), ref, alt)


def split_locus_key(c: Column) -> list[Column]:
    """chrom, pos, ref and alt of a locus key with dashes or colons."""
    parts = F.split(c, "[-:]", 4)
    return [F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("pos"), F.get(parts, F.lit(2)).alias("ref"), F.get(parts, F.lit(3)).alias("alt")]


def maf(p: Column) -> Column:
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.least(q, 1 - q)


def percent(n: Column, d: Column) -> Column:
    """With two decimals, half to even; 0 without a denominator."""
    return F.when(d > 0, F.bround(n / F.nullif(d, F.lit(0)) * 100, 2)).otherwise(0.0)
