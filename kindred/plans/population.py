"""Frequencies by population and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators import counts, linalg, ordinals, popgen
from .cohort import ALLELES, CTE, dosages
from .fixture import genotypes
from .registry import query

POPS = ["east", "north", "south", "west"]
REFS = ["ref_a", "ref_b"]

AF = f"""{ALLELES}, b2 AS (SELECT rsid, LEAST(major,minor) AS r, GREATEST(major,minor) AS t FROM bi WHERE major<>minor),
af AS (SELECT pop, concat_ws('-', chrom, CAST(pos AS VARCHAR), r, t) AS locus_key, u.rsid,
  SUM((substr(gt,1,1)=t)::INT+(substr(gt,2,1)=t)::INT)/CAST(2*COUNT(*) AS DOUBLE) AS allele_freq, 2*COUNT(*) AS allele_number
  FROM u JOIN b2 USING (rsid) GROUP BY pop, chrom, pos, r, t, u.rsid)"""
REFERENCE = "SELECT locus_key, SUM(allele_freq*allele_number) FILTER (pop IN ('north','south'))/SUM(allele_number) FILTER (pop IN ('north','south')) AS ref_a, SUM(allele_freq*allele_number) FILTER (pop IN ('east','west'))/SUM(allele_number) FILTER (pop IN ('east','west')) AS ref_b FROM af GROUP BY locus_key"
WIDE = ", ".join(f"MAX(allele_freq) FILTER (pop='{p}') AS {p}" for p in POPS)
MASTER = f"""{AF}, rf AS ({REFERENCE}), w AS (SELECT locus_key, {WIDE} FROM af GROUP BY locus_key),
ms AS (SELECT * FROM w JOIN rf USING (locus_key) WHERE east IS NOT NULL AND north IS NOT NULL AND south IS NOT NULL AND west IS NOT NULL AND ref_a IS NOT NULL AND ref_b IS NOT NULL)"""
MAF = "LEAST({0},1-{0})"


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.population_af(genotypes(spark, sf_dir))


def reference(af: DataFrame) -> DataFrame:
    side = lambda pops: F.sum(F.when(F.col("pop").isin(pops), F.col("allele_freq") * F.col("allele_number"))) / F.sum(F.when(F.col("pop").isin(pops), F.col("allele_number")))
    return af.groupBy("locus_key").agg(side(["north", "south"]).alias("ref_a"), side(["east", "west"]).alias("ref_b"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    af = frequencies(spark, sf_dir)
    return popgen.master_table(af, POPS, reference(af), REFS)


@query("population_af", f"{AF} SELECT pop, locus_key, rsid, ROUND(allele_freq,6) AS allele_freq, allele_number FROM af")
def population_af(spark, sf_dir):
    return frequencies(spark, sf_dir).withColumn("allele_freq", F.round("allele_freq", 6))


@query(
    "g07_group_af",
    f"""{CTE}, m AS (SELECT 'all' AS grp, * FROM d UNION ALL SELECT 'ns', * FROM d WHERE pop IN ('north','south') UNION ALL SELECT 'e', * FROM d WHERE pop='east')
    SELECT grp, rsid, CAST(COALESCE(SUM(dosage),0) AS BIGINT) AS ac, 2*COUNT(dosage) AS an, ROUND(SUM(dosage)/NULLIF(2.0*COUNT(dosage),0),6) AS af FROM m GROUP BY ALL""",
)
def group_af(spark, sf_dir):
    rows = counts.group_af(dosages(spark, sf_dir), {"all": POPS, "ns": ["north", "south"], "e": ["east"]})
    return rows.withColumn("af", F.round(F.when(F.col("an") > 0, F.col("af")), 6))


@query("j01_shared_loci", f"{AF} SELECT pop, locus_key FROM af WHERE locus_key IN (SELECT locus_key FROM af GROUP BY locus_key HAVING COUNT(DISTINCT pop)=4)")
def shared_loci(spark, sf_dir):
    return popgen.shared_loci(frequencies(spark, sf_dir), 4).select("pop", "locus_key")


@query("j16_population_pairs", f"{AF} SELECT a.pop AS pop1, b.pop AS pop2, COUNT(*) AS loci FROM af a JOIN af b ON a.locus_key=b.locus_key AND a.pop<b.pop GROUP BY ALL")
def population_pairs(spark, sf_dir):
    return popgen.population_pairs(frequencies(spark, sf_dir)).groupBy("pop1", "pop2").agg(F.count("*").alias("loci"))


WC = f"""{AF}, pr AS (SELECT a.pop AS pop1, b.pop AS pop2, a.locus_key, a.allele_freq AS p1, CAST(a.allele_number AS DOUBLE) AS n1, b.allele_freq AS p2, CAST(b.allele_number AS DOUBLE) AS n2 FROM af a JOIN af b ON a.locus_key=b.locus_key AND a.pop<b.pop),
s1 AS (SELECT *, (n1+n2)/2 AS nb, (n1*p1+n2*p2)/(n1+n2) AS p, n1+n2-(n1*n1+n2*n2)/(n1+n2) AS nc, CASE WHEN n1>1 THEN 2*n1*p1*(1-p1)/(2*n1-1) END AS h1, CASE WHEN n2>1 THEN 2*n2*p2*(1-p2)/(2*n2-1) END AS h2 FROM pr),
s2 AS (SELECT *, (n1*(p1-p)*(p1-p)+n2*(p2-p)*(p2-p))/nb AS s, (h1+h2)/2 AS h FROM s1),
wc AS (SELECT pop1, pop2, locus_key, nb/NULLIF(nc,0)*(s-(p*(1-p)-s/2-h/4)/NULLIF(nb-1,0)) AS a, nb/NULLIF(nb-1,0)*(p*(1-p)-s/2-(2*nb-1)*h/(4*nb)) AS b, h/2 AS c FROM s2)"""


@query("g08_fst_components", f"{WC} SELECT pop1, pop2, locus_key, ROUND(a,6) AS a, ROUND(b,6) AS b, ROUND(c,6) AS c FROM wc")
def fst_components(spark, sf_dir):
    a, b, c = popgen.components(F.col("p1"), F.col("n1"), F.col("p2"), F.col("n2"))
    return popgen.population_pairs(frequencies(spark, sf_dir)).select("pop1", "pop2", "locus_key", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(c, 6).alias("c"))


FST = f"{WC}, fst AS (SELECT pop1, pop2, COUNT(*) AS snps, SUM(a)/NULLIF(SUM(a+b+c),0) AS fst FROM wc WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY ALL)"


@query("g09_pairwise_fst", f"{FST} SELECT pop1, pop2, snps, ROUND(fst,6) AS fst FROM fst")
def pairwise_fst(spark, sf_dir):
    return popgen.pairwise_fst(frequencies(spark, sf_dir)).withColumn("fst", F.round("fst", 6))


@query(
    "g10_fst_matrix",
    f"""{FST}, b AS (SELECT pop1 AS pop, pop2 AS o, fst FROM fst UNION ALL SELECT pop2, pop1, fst FROM fst)
    SELECT pop, {", ".join(f"CASE WHEN pop='{p}' THEN 0.0::DOUBLE ELSE ROUND(MAX(fst) FILTER (o='{p}'),6) END AS {p}" for p in POPS)} FROM b GROUP BY pop""",
)
def fst_matrix(spark, sf_dir):
    m = popgen.fst_matrix(popgen.pairwise_fst(frequencies(spark, sf_dir)), POPS)
    return m.select("pop", *(F.round(p, 6).alias(p) for p in POPS))


ROUNDED = ", ".join(f"ROUND({c},6) AS {c}" for c in (*POPS, *REFS))


@query("j02_f21_master_table", f"{MASTER} SELECT locus_key, {ROUNDED} FROM ms")
def master_table(spark, sf_dir):
    return master(spark, sf_dir).select("locus_key", *(F.round(c, 6).alias(c) for c in (*POPS, *REFS)))


@query("f20_common_in_some", f"{MASTER} SELECT locus_key FROM ms WHERE GREATEST({', '.join(MAF.format(p) for p in POPS)})>=0.2")
def common_in_some(spark, sf_dir):
    return popgen.common_in_some(master(spark, sf_dir), POPS, 0.2).select("locus_key")


@query("g29_distribution", f"{MASTER} " + " UNION ALL ".join(f"SELECT '{c}' AS name, ROUND(AVG({c}),6) AS mean, ROUND(STDDEV_SAMP({c}),6) AS sd FROM ms" for c in (*POPS, *REFS)))
def distribution(spark, sf_dir):
    return popgen.distribution(master(spark, sf_dir), [*POPS, *REFS]).select("name", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


DELTAS = f"{MASTER}, de AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pop, locus_key, ROUND({p}-ref_a,9) AS delta FROM ms WHERE {MAF.format('ref_a')}>=0.01" for p in POPS) + ")"


@query(
    "w06_outliers",
    f"""{DELTAS}, rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pop ORDER BY delta DESC, locus_key) AS up, ROW_NUMBER() OVER (PARTITION BY pop ORDER BY delta, locus_key) AS dn FROM de)
    SELECT pop, 'ref_a' AS reference, 'enriched' AS direction, CAST(up AS INTEGER) AS rank, locus_key, ROUND(delta,6) AS delta FROM rk WHERE up<=25
    UNION ALL SELECT pop, 'ref_a', 'depleted', CAST(dn AS INTEGER), locus_key, ROUND(delta,6) FROM rk WHERE dn<=25""",
)
def outliers(spark, sf_dir):
    return popgen.outliers(master(spark, sf_dir), POPS, "ref_a").withColumn("delta", F.round("delta", 6))


PANELS = f"""{MASTER}, ai AS (SELECT locus_key, ROUND(ABS(ref_a-ref_b),9) AS d, ROUND((ref_a+ref_b)/2,9) AS m FROM ms WHERE {MAF.format("ref_a")}>=0.05 AND {MAF.format("ref_b")}>=0.05),
rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY d DESC, m, locus_key) AS rank FROM ai)"""


@query("t01_aims", f"{PANELS} SELECT 'ref_a_ref_b' AS panel, CAST(rank AS INTEGER) AS rank, locus_key, ROUND(d,6) AS delta_abs, ROUND(m,6) AS pooled_af FROM rk WHERE rank<=50")
def aims(spark, sf_dir):
    return popgen.aims(master(spark, sf_dir), "ref_a", "ref_b", 50).withColumns({"delta_abs": F.round("delta_abs", 6), "pooled_af": F.round("pooled_af", 6)})


@query(
    "u02_combined_panels",
    f"""{CTE}, v AS (SELECT DISTINCT rsid AS locus_key, pos, ref, alt FROM g), p AS (
    SELECT 0 AS pr, 'a' AS panel, locus_key, ROW_NUMBER() OVER (ORDER BY pos) AS rank FROM v WHERE ref='A' UNION ALL SELECT 1, 'b', locus_key, ROW_NUMBER() OVER (ORDER BY pos DESC) FROM v WHERE alt='T'),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY locus_key ORDER BY pr, rank) AS n FROM p) SELECT panel, locus_key, CAST(rank AS INTEGER) AS rank FROM r WHERE n=1""",
)
def combined_panels(spark, sf_dir):
    v = genotypes(spark, sf_dir).select(F.col("rsid").alias("locus_key"), "pos", "ref", "alt").distinct()
    a = ordinals.numbered(v.where("ref = 'A'"), ["pos"], "rank").select(F.lit("a").alias("panel"), "locus_key", F.col("rank").cast("int"))
    b = ordinals.numbered(v.where("alt = 'T'"), [F.desc("pos")], "rank").select(F.lit("b").alias("panel"), "locus_key", F.col("rank").cast("int"))
    return popgen.combined_aims([a, b]).select("panel", "locus_key", "rank")


@query("u03_j09_common_variants", f"{CTE} SELECT rsid FROM g WHERE pop='north' INTERSECT SELECT rsid FROM g WHERE pop='south'")
def common_variants(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    return popgen.common_variants(g.where("pop = 'north'"), g.where("pop = 'south'"), 1)


@query(
    "u04_j20_differences",
    f"""{CTE}, a AS (SELECT DISTINCT rsid FROM g WHERE pop='north' AND gt='--'), b AS (SELECT DISTINCT rsid FROM g WHERE pop='south' AND gt='--')
    SELECT 'left' AS side, rsid FROM a WHERE rsid NOT IN (SELECT rsid FROM b) UNION ALL SELECT 'right', rsid FROM b WHERE rsid NOT IN (SELECT rsid FROM a)""",
)
def differences(spark, sf_dir):
    g = genotypes(spark, sf_dir).where("gt = '--'")
    return popgen.set_differences(g.where("pop = 'north'"), g.where("pop = 'south'"), "rsid")


@query(
    "j10_merged_cohorts",
    f"""{CTE}, a AS (SELECT sample_id, rsid, gt FROM g WHERE pop IN ('north','south')), b AS (SELECT sample_id, rsid, CASE WHEN pos%10000=0 AND gt NOT IN ('--','NN') THEN 'TA' ELSE gt END AS gt FROM g WHERE pop IN ('east','west')),
    ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), s AS (SELECT rsid, substr(gt,1,1) AS x FROM ab WHERE regexp_matches(gt,'^[ACGT][ACGT]$') UNION ALL SELECT rsid, substr(gt,2,1) FROM ab WHERE regexp_matches(gt,'^[ACGT][ACGT]$'))
    SELECT rsid, COUNT(*) AS rows FROM ab WHERE rsid NOT IN (SELECT rsid FROM s GROUP BY rsid HAVING COUNT(DISTINCT x)>2) GROUP BY rsid""",
)
def merged_cohorts(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    odd = F.when((F.col("pos") % 10_000 == 0) & ~F.col("gt").isin("--", "NN"), "TA").otherwise(F.col("gt"))
    a = g.where(F.col("pop").isin("north", "south")).select("sample_id", "rsid", "gt")
    b = g.where(F.col("pop").isin("east", "west")).select("sample_id", "rsid", odd.alias("gt"))
    return popgen.merged_cohorts(a, b).groupBy("rsid").agg(F.count("*").alias("rows"))


@query("w01_first_row", f"{CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rsid ORDER BY sample_id) AS n FROM g) SELECT rsid, sample_id, gt FROM r WHERE n=1")
def first_row(spark, sf_dir):
    return popgen.first_by(genotypes(spark, sf_dir), ["rsid"], ["sample_id"]).select("rsid", "sample_id", "gt")


@query("w05_last_row", f"{CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rsid ORDER BY gs DESC, sample_id DESC) AS n FROM g) SELECT rsid, sample_id, gt FROM r WHERE n=1")
def last_row(spark, sf_dir):
    return popgen.last_by(genotypes(spark, sf_dir), ["rsid"], ["gs", "sample_id"]).select("rsid", "sample_id", "gt")


@query("w09_capped", f"{CTE}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pop ORDER BY sample_id, pos) AS n FROM g) SELECT pop, sample_id, rsid FROM r WHERE n<=20")
def capped(spark, sf_dir):
    return popgen.capped(genotypes(spark, sf_dir), "pop", ["sample_id", "pos"], 20).select("pop", "sample_id", "rsid")


@query("s12_u06_locus_map", f"{CTE}, m AS (SELECT chrom, pos, CASE WHEN sample_id=3 AND pos%20000=0 THEN 'rs0' ELSE rsid END AS rsid FROM g) SELECT chrom, pos, MIN(rsid) AS rsid FROM m GROUP BY chrom, pos HAVING COUNT(DISTINCT rsid)=1")
def locus_map(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    return popgen.unambiguous_map(g.select("chrom", "pos", F.when((F.col("sample_id") == 3) & (F.col("pos") % 20_000 == 0), "rs0").otherwise(F.col("rsid")).alias("rsid")))


@query("m06_population_pca")
def population_pca(spark, sf_dir):
    return linalg.pca(linalg.population_rows(popgen.shared_loci(frequencies(spark, sf_dir), 4)), 3)


@query("m07_aims_pca")
def aims_pca(spark, sf_dir):
    return linalg.pca(linalg.population_rows(popgen.shared_loci(frequencies(spark, sf_dir), 4), "locus_key"), 2)


@query("m08_population_tree")
def population_tree(spark, sf_dir):
    return linalg.population_tree(popgen.pairwise_fst(frequencies(spark, sf_dir)))
