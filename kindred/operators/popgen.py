"""Population comparisons: fixation indices, reference frequencies, outliers and ancestry-informative markers."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..params import DEFAULT
from .ordinals import numbered


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, or an error if ``key`` repeats: a join on it would multiply rows."""
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df


def shared_loci(af: DataFrame, populations: int) -> DataFrame:
    """Rows of loci that have a frequency in every population; a semi-join on a count, not a chain of joins."""
    full = af.where("allele_freq is not null").groupBy("locus_key").agg(F.count_distinct("pop").alias("n")).where(F.col("n") == populations)
    return af.join(full.select("locus_key"), "locus_key", "left_semi")


def components(p1: Column, n1: Column, p2: Column, n2: Column) -> tuple[Column, Column, Column]:
    """Weir and Cockerham's variance components of two populations with allele numbers n1 and n2; null if undefined."""

    def over(a: Column, b: Column) -> Column:
        return a / F.nullif(b, F.lit(0.0))

    total = (n1 + n2).cast("double")
    mean_n = total / 2
    p = over(n1 * p1 + n2 * p2, total)
    nc = total - over(n1.cast("double") * n1 + n2.cast("double") * n2, total)
    s2 = over(n1 * (p1 - p) * (p1 - p) + n2 * (p2 - p) * (p2 - p), mean_n)
    het = [F.when(n > 1, 2 * n * q * (1 - q) / (2 * n - 1)) for q, n in ((p1, n1), (p2, n2))]
    h = (het[0] + het[1]) / 2
    inner = p * (1 - p) - s2 / 2
    a = over(mean_n, nc) * (s2 - over(inner - h / 4, mean_n - 1))
    b = over(mean_n, mean_n - 1) * (inner - over((2 * mean_n - 1) * h, 4 * mean_n))
    return a, b, h / 2


def population_pairs(af: DataFrame) -> DataFrame:
    """``(pop1, pop2, locus_key, p1, n1, p2, n2)`` for each pair of populations at each locus, pop1 < pop2.

    A locus's populations meet once, as an array, from which its pairs are made; the table isn't joined with itself.
    """
    own = F.array_sort(F.collect_list(F.struct("pop", F.col("allele_freq").alias("p"), F.col("allele_number").alias("n"))))
    loci = af.groupBy("locus_key").agg(own.alias("of"))
    later = lambda i: F.slice("of", i + 2, F.size("of"))
    pairs = F.flatten(F.transform("of", lambda x, i: F.transform(later(i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    rows = loci.select("locus_key", F.explode(pairs).alias("z")).where("z.x.pop < z.y.pop")
    return rows.select(F.col("z.x.pop").alias("pop1"), F.col("z.y.pop").alias("pop2"), "locus_key", F.col("z.x.p").alias("p1"), F.col("z.x.n").alias("n1"), F.col("z.y.p").alias("p2"), F.col("z.y.n").alias("n2"))


def pairwise_fst(af: DataFrame) -> DataFrame:
    """``(pop1, pop2, snps, fst)``: the ratio of summed components, over loci where all three are defined."""
    a, b, c = components(F.col("p1"), F.col("n1"), F.col("p2"), F.col("n2"))
    rows = population_pairs(af).select("pop1", "pop2", a.alias("a"), b.alias("b"), c.alias("c")).where("a is not null and b is not null and c is not null")
    sums = rows.groupBy("pop1", "pop2").agg(F.count("*").alias("snps"), F.sum("a").alias("num"), F.sum(F.col("a") + F.col("b") + F.col("c")).alias("den"))
    return sums.select("pop1", "pop2", "snps", (F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).alias("fst"))


def fst_matrix(fst: DataFrame, populations: list[str]) -> DataFrame:
    """The symmetric matrix with a zero diagonal, a column a population."""
    rows = fst.select("pop1", "pop2", "fst").unionByName(fst.select(F.col("pop2").alias("pop1"), F.col("pop1").alias("pop2"), "fst"))
    wide = rows.groupBy(F.col("pop1").alias("pop")).pivot("pop2", populations).agg(F.first("fst"))
    return wide.select("pop", *(F.when(F.col("pop") == p, 0.0).otherwise(F.col(p)).alias(p) for p in populations))


def wide_af(af: DataFrame, populations: list[str]) -> DataFrame:
    """A column of frequencies a population, for sinks; populations are given, so no job looks for them."""
    return af.groupBy("locus_key").pivot("pop", populations).agg(F.first("allele_freq"))


def master_table(af: DataFrame, populations: list[str], reference: DataFrame, references: list[str]) -> DataFrame:
    """Frequencies of ``populations`` beside those of ``references``, complete cases only."""
    rows = wide_af(af, populations).join(reference.select("locus_key", *references), "locus_key", "left")
    return rows.na.drop(subset=[*populations, *references])


def common_in_some(wide: DataFrame, populations: list[str], least: float = 0.05) -> DataFrame:
    """Loci whose minor allele reaches ``least`` in some population."""
    return wide.where(F.greatest(*(G.maf(F.col(p)) for p in populations)) >= least)


def distribution(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, mean, sd)`` of each column in one pass."""
    pairs = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    return pairs.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def outliers(master: DataFrame, populations: list[str], reference: str, top: int = DEFAULT.top_outliers, least: float = DEFAULT.min_reference_af, digits: int = 9) -> DataFrame:
    """``(pop, reference, direction, rank, locus_key, delta)``: the ``top`` loci above and below the reference.

    Differences are compared at ``digits`` decimals, beyond which they are noise of the sums' order; ties go by locus key. Fewer are given where fewer loci are common in the reference.
    """
    rows = master.where(G.maf(F.col(reference)) >= least)
    each = F.array(*(F.struct(F.lit(p).alias("pop"), F.round(F.col(p) - F.col(reference), digits).alias("delta")) for p in populations))
    rows = rows.select("locus_key", F.explode(each).alias("x")).select("locus_key", "x.*")
    out = []
    for direction, order in (("enriched", F.col("delta").desc()), ("depleted", F.col("delta").asc())):
        rank = F.row_number().over(Window.partitionBy("pop").orderBy(order, "locus_key"))
        out.append(rows.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("direction", F.lit(direction)))
    return out[0].unionByName(out[1]).select("pop", F.lit(reference).alias("reference"), "direction", "rank", "locus_key", "delta")


def aims(master: DataFrame, a: str, b: str, top: int = DEFAULT.top_aims, least: float = DEFAULT.aim_maf, digits: int = 9) -> DataFrame:
    """``(panel, rank, locus_key, delta_abs, pooled_af)``: the markers that tell two references apart best, at ``digits`` decimals."""
    rows = master.where((G.maf(F.col(a)) >= least) & (G.maf(F.col(b)) >= least))
    rows = rows.select("locus_key", F.round(F.abs(F.col(a) - F.col(b)), digits).alias("delta_abs"), F.round((F.col(a) + F.col(b)) / 2, digits).alias("pooled_af"))
    order = [F.col("delta_abs").desc(), F.col("pooled_af").asc(), F.col("locus_key").asc()]
    best = rows.orderBy(*order).limit(top)  # at most ``top`` rows reach the window
    return best.select(F.lit(f"{a}_{b}").alias("panel"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "locus_key", "delta_abs", "pooled_af")


def combined_aims(panels: list[DataFrame]) -> DataFrame:
    """The distinct markers of several panels, each from the first panel that has it."""
    every = None
    for k, panel in enumerate(panels):
        marked = panel.withColumn("priority", F.lit(k))
        every = marked if every is None else every.unionByName(marked)
    first = F.row_number().over(Window.partitionBy("locus_key").orderBy("priority", "rank"))
    return every.withColumn("nth", first).where("nth = 1").drop("nth", "priority")


def aim_panels(master: DataFrame, references: list[str], **options) -> DataFrame:
    return combined_aims([aims(master, a, b, **options) for a, b in itertools.combinations(references, 2)])


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


def last_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))).where("nth = 1").drop("nth")


def capped(df: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each key: the first in order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= limit).drop("nth")


def bed_sites(loci: DataFrame) -> DataFrame:
    """``(nth, chrom, start, end, name)`` of ``loci (locus_key)``: half-open places, numbered by chromosome and position.

    Loci of other chromosomes than 1 to 22, X, Y and MT are left out.
    """
    parts = F.split("locus_key", "-")
    chrom = F.get(parts, F.lit(0))
    code = F.when(chrom.rlike("^([1-9]|1[0-9]|2[0-2])$"), chrom.try_cast("int")).when(chrom == "X", 23).when(chrom == "Y", 24).when(chrom == "MT", 25)
    rows = loci.select(code.alias("code"), F.concat(F.lit("chr"), chrom).alias("chrom"), F.get(parts, F.lit(1)).cast("long").alias("end"), F.col("locus_key").alias("name")).where("code is not null")
    return numbered(rows, ["code", "end", "name"], "nth").select(F.col("nth").cast("int").alias("nth"), "chrom", (F.col("end") - 1).alias("start"), "end", "name")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(side, key)``: keys only in ``a`` (left) or only in ``b`` (right)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").select(F.lit("left").alias("side"), key).unionByName(y.join(x, key, "left_anti").select(F.lit("right").alias("side"), key))


def snp_universe(g: DataFrame) -> DataFrame:
    """``(rsid, chrom, pos)`` of every rsid, as its first row in order of sample and line has it."""
    return g.groupBy("rsid").agg(F.min_by(F.struct("chrom", "pos"), F.struct("sample_id", "line_number")).alias("at")).select("rsid", "at.chrom", "at.pos")


def unambiguous_map(loci: DataFrame) -> DataFrame:
    """``(chrom, pos, rsid)`` of the loci with one rsid only."""
    rows = loci.where(F.col("chrom").isNotNull() & (F.col("pos") > 0) & (G.canonical_rsid(F.col("rsid")) != ""))
    rows = rows.select(F.trim("chrom").alias("chrom"), "pos", G.canonical_rsid(F.col("rsid")).alias("rsid"))
    return rows.groupBy("chrom", "pos").agg(F.count_distinct("rsid").alias("n"), F.min("rsid").alias("rsid")).where("n = 1").drop("n")


def merged_cohorts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two cohorts' calls, without the variants that show over two alleles across both."""
    both = a.unionByName(b)
    seen = both.where(G.is_snp(F.col("gt"))).select("rsid", F.explode(F.array(F.substring("gt", 1, 1), F.substring("gt", 2, 1))).alias("base"))
    bad = seen.groupBy("rsid").agg(F.count_distinct("base").alias("n")).where("n > 2").select("rsid")
    return both.join(bad, "rsid", "left_anti")


def common_variants(a: DataFrame, b: DataFrame, least: int = 100) -> DataFrame:
    """Variants in both; an error if fewer than ``least`` are."""
    both = a.select("rsid").distinct().join(b.select("rsid").distinct(), "rsid", "left_semi")
    if (n := both.count()) < least:
        raise ValueError(f"{n} variants in common; {least} are needed")
    return both
