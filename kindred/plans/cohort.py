"""Counts, filters, linkage and components over the cohort's genotypes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators import counts, filters, ld, linalg, ordinals, popgen, sexbias
from ..params import DEFAULT
from ..sources.shared import scratch
from ..streaming import batches
from .fixture import GENOTYPES_SQL, genotypes
from .registry import query

#: The test tables have 16 % of calls missing, so thresholds are looser than the defaults.
LOOSE = replace(DEFAULT, geno=0.30, mind=0.40, maf=0.05)

CTE = f"""WITH g AS ({GENOTYPES_SQL}),
u AS (SELECT * FROM g WHERE gs >= 0.15 AND regexp_matches(gt, '^[ACGT][ACGT]$')),
d AS (SELECT *, CASE WHEN gs >= 0.15 AND substr(gt,1,1) IN (ref,alt) AND substr(gt,2,1) IN (ref,alt)
  THEN (substr(gt,1,1)=alt)::INT + (substr(gt,2,1)=alt)::INT END AS dosage FROM g)"""
BASES = ", ".join(f"CAST(SUM((substr(gt,1,1)='{b}')::INT + (substr(gt,2,1)='{b}')::INT) AS BIGINT) AS \"n_{b}\"" for b in "ACGT")


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.with_dosage(genotypes(spark, sf_dir))


@query("g01_allele_counts", f"{CTE} SELECT rsid, {BASES} FROM u GROUP BY rsid")
def allele_counts(spark, sf_dir):
    return counts.allele_counts(counts.usable(genotypes(spark, sf_dir)), "rsid")


ALLELES = f"""{CTE}, a AS (SELECT rsid, substr(gt,1,1) AS base FROM u UNION ALL SELECT rsid, substr(gt,2,1) FROM u),
c AS (SELECT rsid, base, COUNT(*) AS n FROM a GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rsid ORDER BY n DESC, base) AS nth, COUNT(*) OVER (PARTITION BY rsid) AS k FROM c),
bi AS (SELECT rsid, MAX(CASE WHEN nth=1 THEN base END) AS major, MAX(CASE WHEN nth=k THEN base END) AS minor FROM r WHERE k<=2 GROUP BY rsid)"""


@query("g02_biallelic", f"{ALLELES} SELECT rsid, major, minor FROM bi")
def biallelic(spark, sf_dir):
    return counts.biallelic(counts.allele_counts(counts.usable(genotypes(spark, sf_dir)), "rsid")).select("rsid", "major", "minor")


@query(
    "x16_minor_dosage",
    f"""{ALLELES} SELECT u.rsid, CAST(SUM((substr(gt,1,1)=minor)::INT + (substr(gt,2,1)=minor)::INT) AS BIGINT) AS minor_alleles, COUNT(*) AS calls
    FROM u JOIN bi USING (rsid) GROUP BY u.rsid""",
)
def minor_dosage(spark, sf_dir):
    u = counts.usable(genotypes(spark, sf_dir))
    d = counts.minor_dosage(u, counts.biallelic(counts.allele_counts(u, "rsid")))
    return d.groupBy("rsid").agg(F.sum("dosage").alias("minor_alleles"), F.count("*").alias("calls"))


@query(
    "g03_oriented_alleles",
    f"""{ALLELES}, f AS (SELECT rsid, arg_min(substr(gt,1,1), sample_id) AS anchor FROM u GROUP BY rsid),
    x AS (SELECT bi.*, anchor, (SELECT n FROM c WHERE c.rsid=bi.rsid AND base=major) = (SELECT n FROM c WHERE c.rsid=bi.rsid AND base=minor) AND anchor=minor AS swap FROM bi JOIN f USING (rsid))
    SELECT rsid, CASE WHEN major=minor THEN '0' WHEN swap THEN major ELSE minor END AS a1, CASE WHEN swap THEN minor ELSE major END AS a2 FROM x""",
)
def oriented(spark, sf_dir):
    return counts.oriented(counts.usable(genotypes(spark, sf_dir)))


CLASSES = """COUNT(*) FILTER (dosage=0) AS n_homref, COUNT(*) FILTER (dosage=1) AS n_het, COUNT(*) FILTER (dosage=2) AS n_homalt"""


@query("g04_class_counts", f"{CTE} SELECT rsid, {CLASSES}, COUNT(*) FILTER (dosage IS NULL) AS n_missing FROM d GROUP BY rsid")
def class_counts(spark, sf_dir):
    return counts.class_counts(dosages(spark, sf_dir), "rsid")


@query(
    "g05_allele_stats",
    f"""{CTE} SELECT rsid, 2*COUNT(dosage) AS allele_number, ROUND(SUM(dosage)/NULLIF(2.0*COUNT(dosage),0),6) AS allele_freq,
    ROUND(1-COUNT(dosage)/(SELECT CAST(COUNT(DISTINCT sample_id) AS DOUBLE) FROM g),6) AS missing_rate FROM d GROUP BY rsid""",
)
def allele_stats(spark, sf_dir):
    d = dosages(spark, sf_dir)
    n = d.select("sample_id").distinct().count()
    rows = counts.allele_stats(d, n, "rsid")
    return rows.select("rsid", "allele_number", F.round("allele_freq", 6).alias("allele_freq"), F.round("missing_rate", 6).alias("missing_rate"))


@query("g31_dosage_histogram", f"{CTE} SELECT COUNT(*) AS cells, ROUND(AVG((dosage IS NULL)::INT),6) AS missing_rate, COUNT(*) FILTER (dosage=0) AS dosage_0, COUNT(*) FILTER (dosage=1) AS dosage_1, COUNT(*) FILTER (dosage=2) AS dosage_2 FROM d")
def dosage_histogram(spark, sf_dir):
    return counts.dosage_histogram(dosages(spark, sf_dir))


@query("f04_f06_usable_calls", f"{CTE} SELECT sample_id, COUNT(*) AS calls FROM u GROUP BY sample_id")
def usable_calls(spark, sf_dir):
    return counts.usable(genotypes(spark, sf_dir)).groupBy("sample_id").agg(F.count("*").alias("calls"))


@query(
    "f05_compartments",
    f"{CTE} SELECT CASE WHEN chrom='X' THEN 'x' ELSE 'auto' END AS region, sex, COUNT(*) AS signals, CAST(SUM((substr(gt,1,1)<>substr(gt,2,1))::INT) AS BIGINT) AS het FROM g WHERE regexp_matches(gt,'^[ACGT][ACGT]$') GROUP BY ALL",
)
def compartments(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    s = sexbias.signals(g).join(g.select("sample_id", "sex").distinct(), "sample_id")
    return s.groupBy("region", "sex").agg(F.count("*").alias("signals"), F.sum("signal").alias("het"))


MISSING = f"""{CTE}, nv AS (SELECT COUNT(DISTINCT rsid) AS v FROM g),
m AS (SELECT sample_id, (SELECT v FROM nv) - COUNT(dosage) AS n_missing FROM d GROUP BY sample_id)"""


@query("f07_sample_missingness", f"{MISSING} SELECT sample_id, n_missing, ROUND(n_missing/(SELECT CAST(v AS DOUBLE) FROM nv),6) AS missing_rate FROM m")
def sample_missingness(spark, sf_dir):
    d = dosages(spark, sf_dir)
    rows = filters.sample_missingness(d, d.select("rsid").distinct().count())
    return rows.select("sample_id", "n_missing", F.round("missing_rate", 6).alias("missing_rate"))


VARIANTS = f"""{MISSING}, k AS (SELECT sample_id FROM m WHERE n_missing/(SELECT CAST(v AS DOUBLE) FROM nv) <= 0.40), ns AS (SELECT COUNT(*) AS s FROM k),
c AS (SELECT rsid, {CLASSES} FROM d WHERE sample_id IN (SELECT sample_id FROM k) GROUP BY rsid),
s AS (SELECT *, CAST(n_homref+n_het+n_homalt AS DOUBLE) AS n, (2*n_homalt+n_het)/NULLIF(2.0*(n_homref+n_het+n_homalt),0) AS q FROM c),
e AS (SELECT *, n*(1-q)*(1-q) AS e0, n*2*(1-q)*q AS e1, n*q*q AS e2, n/(SELECT CAST(s AS DOUBLE) FROM ns) AS call_rate, COALESCE(LEAST(q,1-q),0) AS maf FROM s),
x AS (SELECT *, CASE WHEN LEAST(e0,e1,e2)>=1e-6 THEN (n_homref-e0)*(n_homref-e0)/e0+(n_het-e1)*(n_het-e1)/e1+(n_homalt-e2)*(n_homalt-e2)/e2 END AS chi2 FROM e)"""


@query(
    "f08_f12_variant_filters",
    f"""{VARIANTS} SELECT rsid, n_homref, n_het, n_homalt, (SELECT s FROM ns) - CAST(n AS BIGINT) AS n_missing, ROUND(call_rate,6) AS call_rate, ROUND(maf,6) AS maf, ROUND(chi2,6) AS chi2,
    CASE WHEN 1-call_rate>0.30 THEN 'call_rate' WHEN maf<0.05 THEN 'maf' WHEN chi2>15.136705226623 THEN 'hwe' ELSE 'pass' END AS filter FROM x""",
)
def variant_filters(spark, sf_dir):
    rows = filters.variant_qc(dosages(spark, sf_dir), LOOSE)
    return rows.select("rsid", "n_homref", "n_het", "n_homalt", "n_missing", *(F.round(c, 6).alias(c) for c in ("call_rate", "maf", "chi2")), "filter")


@query("f13_all_reasons", f"{VARIANTS} SELECT rsid, concat_ws(',', CASE WHEN 1-call_rate>0.30 THEN 'GENO' END, CASE WHEN maf<0.05 THEN 'MAF' END, CASE WHEN chi2>15.136705226623 THEN 'HWE' END) AS reasons FROM x")
def all_reasons(spark, sf_dir):
    return filters.all_reasons(filters.variant_qc(dosages(spark, sf_dir), LOOSE), LOOSE).select("rsid", "reasons")


#: The probability of a number of heterozygotes, given the alleles, by logarithms; the sum over those no likelier.
HWE = f"""{CTE}, c AS (SELECT rsid, {CLASSES} FROM d GROUP BY rsid),
n AS (SELECT *, n_homref+n_het+n_homalt AS n, 2*LEAST(n_homref,n_homalt)+n_het AS rare FROM c),
h AS (SELECT *, unnest(range(rare%2, rare+1, 2)) AS h FROM n),
l AS (SELECT *, h*LN(2) - LGAMMA((rare-h)/2+1) - LGAMMA(h+1) - LGAMMA(n-(rare+h)/2+1) AS lp FROM h),
o AS (SELECT rsid, ANY_VALUE(lp) AS own FROM l WHERE h=n_het GROUP BY rsid)
SELECT rsid, ROUND(LEAST(1.0, COALESCE(SUM(EXP(lp-own)) FILTER (lp<=own+1e-9)/SUM(EXP(lp-own)),1)),6) AS hwe_exact FROM l JOIN o USING (rsid) GROUP BY rsid"""


@query("f11_hwe_exact", HWE)
def hwe_exact(spark, sf_dir):
    return filters.hwe_exact(counts.class_counts(dosages(spark, sf_dir), "rsid")).select("rsid", F.round("hwe_exact", 6).alias("hwe_exact"))


@query("j19_dropped_variants", f"{VARIANTS} SELECT DISTINCT rsid FROM g WHERE rsid NOT IN (SELECT rsid FROM x WHERE 1-call_rate<=0.30 AND maf>=0.05 AND NOT COALESCE(chi2>15.136705226623,false))")
def dropped_variants(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    return filters.dropped(g.select("rsid").distinct(), filters.variant_qc(dosages(spark, sf_dir), LOOSE).where("filter = 'pass'"))


@query(
    "f15_joint_variants",
    f"""{CTE}, s AS (SELECT rsid, SUM(dosage)/NULLIF(2.0*COUNT(dosage),0) AS p, 1-COUNT(dosage)/(SELECT CAST(COUNT(DISTINCT sample_id) AS DOUBLE) FROM g) AS m FROM d GROUP BY rsid),
    r AS (SELECT rsid, concat_ws(';', CASE WHEN p IS NULL THEN 'no_calls' END, CASE WHEN p<0.05 OR p>1-0.05 THEN 'allele_freq' END, CASE WHEN m>0.2 THEN 'missing_rate' END) AS reason FROM s)
    SELECT rsid, reason, CASE WHEN reason='' THEN 'used' ELSE 'dropped' END AS stage FROM r""",
)
def joint_variants(spark, sf_dir):
    d = dosages(spark, sf_dir)
    stats = counts.allele_stats(d, d.select("sample_id").distinct().count(), "rsid")
    return filters.joint_variants(stats, 0.05, 0.2).select("rsid", "reason", "stage")


SIGNALS = f"""{CTE}, s AS (SELECT sample_id, CASE WHEN chrom='X' THEN 'x' ELSE 'auto' END AS region, rsid, (substr(gt,1,1)<>substr(gt,2,1))::INT AS signal FROM g WHERE regexp_matches(gt,'^[ACGT][ACGT]$'))"""


@query(
    "f16_nmf_variants",
    f"""{SIGNALS}, c AS (SELECT region, rsid, COUNT(*) AS called, CAST(SUM(signal) AS DOUBLE) AS t FROM s GROUP BY ALL),
    v AS (SELECT *, LEAST(1.0, called/(SELECT CAST(COUNT(DISTINCT sample_id) AS DOUBLE) FROM g)) AS call_rate, t/called - (t/called)*(t/called) AS variance FROM c)
    SELECT region, rsid, called, ROUND(call_rate,6) AS call_rate, ROUND(variance,6) AS variance, CASE WHEN call_rate<0.8 THEN 'low_call_rate' WHEN variance<=0 THEN 'zero_variance' ELSE 'pass' END AS filter FROM v""",
)
def nmf_variants(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    rows = sexbias.variant_filter(sexbias.signals(g), g.select("sample_id").distinct().count())
    return rows.select("region", "rsid", "called", F.round("call_rate", 6).alias("call_rate"), F.round("variance", 6).alias("variance"), "filter")


@query(
    "f17_nmf_samples",
    f"""{SIGNALS}, c AS (SELECT sample_id, COUNT(*) FILTER (region='auto') AS auto, COUNT(*) FILTER (region='x') AS x FROM s GROUP BY sample_id),
    v AS (SELECT COUNT(DISTINCT rsid) FILTER (chrom<>'X') AS va, COUNT(DISTINCT rsid) FILTER (chrom='X') AS vx FROM g)
    SELECT c.*, CASE WHEN auto<va*75//100 THEN 'low_autosome_signal' WHEN x<vx*75//100 THEN 'low_x_signal' ELSE 'pass' END AS filter FROM c, v""",
)
def nmf_samples(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    auto, x = g.agg(F.count_distinct(F.when(F.col("chrom") != "X", F.col("rsid"))), F.count_distinct(F.when(F.col("chrom") == "X", F.col("rsid")))).first()
    return sexbias.sample_filter(sexbias.signals(g), auto * 75 // 100, x * 75 // 100)


@query("f18_overlap", f"{CTE} SELECT sample_id, COUNT(dosage) AS observed, COUNT(dosage) >= (SELECT CEIL(0.8*COUNT(DISTINCT rsid)) FROM g) AS kept FROM d GROUP BY sample_id HAVING COUNT(dosage)>0")
def overlap(spark, sf_dir):
    d = dosages(spark, sf_dir)
    return filters.enough_overlap(d, d.select("rsid").distinct(), 0.8)


@query("f19_unambiguous", f"{CTE} SELECT DISTINCT rsid, ref, alt FROM g WHERE concat(LEAST(ref,alt),GREATEST(ref,alt)) NOT IN ('AT','CG')")
def unambiguous(spark, sf_dir):
    return filters.unambiguous(genotypes(spark, sf_dir)).select("rsid", "ref", "alt").distinct()


@query(
    "f14_pca_prefilter",
    f"""{CTE}, v AS (SELECT DISTINCT rsid, chrom, pos, alt, CASE WHEN pos%7000=0 THEN 'N' ELSE ref END AS a1, CASE WHEN pos%11000=0 THEN ref ELSE alt END AS a2 FROM g),
    m AS (SELECT * FROM v WHERE alt<>'C')
    SELECT rsid, chrom, pos, concat_ws(';', CASE WHEN a1='N' THEN 'bad_alleles' END, CASE WHEN a1<>'N' AND a1=a2 THEN 'monomorphic' END, CASE WHEN rsid NOT IN (SELECT rsid FROM m) THEN 'off_map' END) AS reasons FROM v""",
)
def pca_prefilter(spark, sf_dir):
    v = genotypes(spark, sf_dir).select("rsid", "chrom", "pos", "alt", F.when(F.col("pos") % 7000 == 0, "N").otherwise(F.col("ref")).alias("a1"), F.when(F.col("pos") % 11000 == 0, F.col("ref")).otherwise(F.col("alt")).alias("a2")).distinct()
    return filters.pca_prefilter(v, v.where("alt <> 'C'")).select("rsid", "chrom", "pos", "reasons")


@query("f23_range", f"{CTE} SELECT sample_id, rsid, gt FROM g WHERE chrom='6' AND pos BETWEEN 30000 AND 110000")
def in_range(spark, sf_dir):
    return filters.in_range(genotypes(spark, sf_dir), "6", 30_000, 110_000).select("sample_id", "rsid", "gt")


@query("f26_subsample", f"{CTE} SELECT DISTINCT rsid FROM g WHERE CAST(substr(rsid,3) AS BIGINT)%14=0")
def subsample(spark, sf_dir):
    return filters.subsample(genotypes(spark, sf_dir)).select("rsid").distinct()


@query(
    "w10_ld_r2",
    f"""{CTE}, o AS (SELECT chrom, rsid, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY pos, rsid) AS ord FROM (SELECT DISTINCT chrom, pos, rsid FROM d)),
    x AS (SELECT d.sample_id, d.chrom, d.rsid, ord, CAST(dosage AS BIGINT) AS v FROM d JOIN o ON d.chrom=o.chrom AND d.rsid=o.rsid WHERE dosage IS NOT NULL),
    p AS (SELECT a.chrom, a.rsid AS a, b.rsid AS b, COUNT(*) AS n, SUM(a.v) AS sx, SUM(b.v) AS sy, SUM(a.v*b.v) AS sxy, SUM(a.v*a.v) AS sxx, SUM(b.v*b.v) AS syy
      FROM x a JOIN x b ON a.sample_id=b.sample_id AND a.chrom=b.chrom AND b.ord>a.ord AND b.ord<=a.ord+5 GROUP BY ALL)
    SELECT chrom, a, b, n, ROUND(CAST((n*sxy-sx*sy)*(n*sxy-sx*sy) AS DOUBLE)/NULLIF((n*sxx-sx*sx)*(n*syy-sy*sy),0),6) AS r2 FROM p""",
)
def ld_r2(spark, sf_dir):
    return ld.pairwise_r2(dosages(spark, sf_dir), 5).select("chrom", "a", "b", "n", F.round("r2", 6).alias("r2"))


@query("m02_ld_prune")
def ld_prune(spark, sf_dir):
    return ld.prune(dosages(spark, sf_dir), 50, 0.2)


@query(
    "g32_gram",
    f"""{CTE}, v AS (SELECT rsid, AVG(dosage) AS m FROM d GROUP BY rsid), x AS (SELECT sample_id, rsid, dosage-m AS x FROM d JOIN v USING (rsid) WHERE dosage IS NOT NULL)
    SELECT a.sample_id AS i, b.sample_id AS j, ROUND(SUM(a.x*b.x),5) AS g FROM x a JOIN x b ON a.rsid=b.rsid AND a.sample_id<=b.sample_id GROUP BY ALL""",
)
def gram(spark, sf_dir):
    return linalg.gram(linalg.centred(dosages(spark, sf_dir))).select("i", "j", F.round("g", 5).alias("g"))


@query("m03_cohort_pca")
def cohort_pca(spark, sf_dir):
    return linalg.pca(linalg.centred(dosages(spark, sf_dir)), 5, of_emitted=True)


@query("m04_joint_pca")
def joint_pca(spark, sf_dir):
    return linalg.randomised_pca(linalg.standardised(dosages(spark, sf_dir)), 10)


LOADINGS = "SELECT rsid, [((pos//1000)%17-8)/100.0::DOUBLE, ((pos//1000)%23-11)/100.0::DOUBLE] AS l, ((pos//1000)%9)/10.0::DOUBLE AS p FROM (SELECT DISTINCT rsid, pos FROM g)"


@query(
    "m05_projection",
    f"""{CTE}, l AS ({LOADINGS}), m AS (SELECT CAST(COUNT(*) AS DOUBLE) AS m FROM l), k AS (SELECT 1 AS pc UNION ALL SELECT 2)
    SELECT sample_id, CAST(pc AS INTEGER) AS pc, ROUND(SUM((dosage-2*p)*l[pc]/SQRT((SELECT m FROM m)*2*p*(1-p))),6) AS score FROM d JOIN l USING (rsid) CROSS JOIN k WHERE dosage IS NOT NULL AND p>0 AND p<1 GROUP BY ALL""",
)
def projection(spark, sf_dir):
    d = dosages(spark, sf_dir)
    n = F.floor(F.col("pos") / 1000)
    loads = d.select("rsid", "pos").distinct().select("rsid", F.array(((n % 17) - 8) / 100.0, ((n % 23) - 11) / 100.0).alias("loadings"), ((n % 9) / 10.0).alias("pca_af"))
    return linalg.project(d, loads).select("sample_id", "pc", F.round("score", 6).alias("score"))


STATS = f"""{CTE}, s AS (SELECT sample_id, chrom, COUNT(*) AS n, AVG((length(gt)=2 AND substr(gt,1,1)<>substr(gt,2,1) AND NOT contains(gt,'0'))::INT) AS het, AVG(gs) AS mg, VAR_SAMP(gs) AS vg FROM g GROUP BY ALL)"""


@query("g11_chromosome_stats", f"{STATS} SELECT sample_id, chrom, n, ROUND(het,6) AS het_rate, ROUND(mg,6) AS mean_gs, ROUND(vg,6) AS var_gs FROM s")
def chromosome_stats(spark, sf_dir):
    rows = sexbias.chromosome_stats(genotypes(spark, sf_dir))
    return rows.select("sample_id", "chrom", "n", *(F.round(c, 6).alias(c) for c in ("het_rate", "mean_gs", "var_gs")))


COMPARTMENTS = f"{STATS}, c AS (SELECT sample_id, AVG(het) FILTER (chrom<>'X') AS auto_het, AVG(het) FILTER (chrom='X') AS x_het, AVG(mg) FILTER (chrom<>'X') AS auto_gs, AVG(mg) FILTER (chrom='X') AS x_gs FROM s GROUP BY sample_id)"


@query("g12_compartment_means", f"{COMPARTMENTS} SELECT sample_id, ROUND(auto_het,6) AS auto_het, ROUND(x_het,6) AS x_het, ROUND(auto_gs,6) AS auto_gs, ROUND(x_gs,6) AS x_gs FROM c")
def compartment_means(spark, sf_dir):
    rows = sexbias.compartments(sexbias.chromosome_stats(genotypes(spark, sf_dir)))
    return rows.select("sample_id", *(F.round(c, 6).alias(c) for c in ("auto_het", "x_het", "auto_gs", "x_gs")))


@query(
    "g12_by_sex",
    f"""{COMPARTMENTS}, b AS (SELECT sex, COUNT(*) AS samples, AVG(auto_het) AS a, AVG(x_het) AS x FROM c JOIN (SELECT DISTINCT sample_id, sex FROM g) USING (sample_id) GROUP BY sex)
    SELECT sex, samples, ROUND(a,6) AS auto_het, ROUND(x,6) AS x_het, ROUND(x/NULLIF(a,0),6) AS ratio FROM b""",
)
def by_sex(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    rows = sexbias.by_sex(sexbias.compartments(sexbias.chromosome_stats(g)), g.select("sample_id", "sex").distinct())
    return rows.select("sex", "samples", *(F.round(c, 6).alias(c) for c in ("auto_het", "x_het", "ratio")))


@query(
    "g13_merged_counts",
    f"{SIGNALS} SELECT region, rsid, COUNT(*) AS called, CAST(SUM(signal) AS BIGINT) AS total, CAST(SUM(signal*signal) AS BIGINT) AS squares FROM s GROUP BY ALL",
)
def merged_counts(spark, sf_dir):
    s = sexbias.signals(genotypes(spark, sf_dir))
    part = lambda df: df.groupBy("region", "rsid").agg(F.count("*").alias("called"), F.sum("signal").alias("total"), F.sum(F.col("signal") * F.col("signal")).alias("squares"))
    return sexbias.merged_counts(part(s.where("sample_id % 2 = 0")).unionByName(part(s.where("sample_id % 2 = 1"))))


@query(
    "g13_merged_batches",
    f"{SIGNALS.replace('rsid, (substr', 'rsid, chrom, pos, (substr')} SELECT region, rsid, MIN(chrom) AS chrom, MIN(pos) AS pos, COUNT(*) AS called, CAST(SUM(signal) AS BIGINT) AS total, CAST(SUM(signal*signal) AS BIGINT) AS squares FROM s GROUP BY ALL",
)
def merged_batches(spark, sf_dir):
    g, folder = genotypes(spark, sf_dir), scratch(spark)
    for batch in (0, 1, 2, 1):  # one of them twice
        batches.write_batch(g.where(F.col("sample_id") % 3 == batch), f"b{batch}", folder)
    return batches.merged(spark, folder)[0]


@query("m09_nmf")
def nmf(spark, sf_dir):
    return sexbias.nmf(sexbias.signals(genotypes(spark, sf_dir)), 3, 100)


@query("w08_u05_snp_universe", f"{CTE} SELECT DISTINCT rsid, chrom, pos FROM g")
def snp_universe(spark, sf_dir):
    return popgen.snp_universe(genotypes(spark, sf_dir).withColumn("line_number", F.col("pos")))


@query(
    "t02_variant_order",
    f"""{CTE}, v AS (SELECT DISTINCT rsid, chrom, pos, CASE WHEN chrom='X' THEN 23 ELSE CAST(chrom AS INT) END AS r FROM g)
    SELECT rsid, CAST(r AS INTEGER) AS rank, CAST(ROW_NUMBER() OVER (ORDER BY r, pos, rsid) AS INTEGER) AS nth FROM v""",
)
def variant_order(spark, sf_dir):
    v = genotypes(spark, sf_dir).select("rsid", "chrom", "pos").distinct().withColumn("rank", G.chrom_rank(F.col("chrom")))
    return ordinals.numbered(v, ["rank", "pos", "rsid"], "nth").select("rsid", "rank", F.col("nth").cast("int").alias("nth"))


@query(
    "w08_dense_ids",
    f"""{CTE}, v AS (SELECT DISTINCT rsid, chrom, pos FROM g) SELECT rsid, ROW_NUMBER() OVER (ORDER BY pos DESC, rsid) AS place, ROW_NUMBER() OVER (PARTITION BY chrom ORDER BY pos, rsid) AS along FROM v""",
)
def dense_ids(spark, sf_dir):
    v = genotypes(spark, sf_dir).select("rsid", "chrom", "pos").distinct()
    return ordinals.numbered(ordinals.numbered(v, [F.desc("pos"), "rsid"], "place"), ["chrom", "pos", "rsid"], "along", ["chrom"]).select("rsid", F.col("place").cast("long").alias("place"), F.col("along").cast("long").alias("along"))
