"""Study calls beside panels, loadings and lists; sweeps over numbers of components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators import ancestry, filters, linalg, lookups, popgen, synth
from ..sources import vcf
from .cohort import CTE, LOOSE, VARIANTS, dosages
from .fixture import GENOTYPES_SQL, genotypes, sql
from .registry import query

#: Calls in file order, some with other alleles than the site's, some with a second row at their locus.
STUDY_SQL = f"""
SELECT sample_id, pos AS line_number, CASE WHEN pos % 9000 = 0 THEN 'X' ELSE chrom END AS chrom, pos, CASE WHEN pos % 5000 = 0 THEN 'TA' ELSE gt END AS gt, gs FROM ({GENOTYPES_SQL}) g1
UNION ALL SELECT sample_id, pos + 1, CASE WHEN pos % 9000 = 0 THEN 'X' ELSE chrom END, pos, concat(alt, ref), gs FROM ({GENOTYPES_SQL}) g2 WHERE (sample_id + pos / 1000) % 4 = 0"""
STUDY = f"{CTE}, st AS ({STUDY_SQL}), pn AS (SELECT DISTINCT chrom, pos, ref, alt, ((pos//1000)%9)/10.0::DOUBLE AS pca_af FROM g WHERE ref<>'G')"
FITS = "length(gt)=2 AND substr(gt,1,1) IN (ref,alt) AND substr(gt,2,1) IN (ref,alt)"
ALTS = "(substr(gt,1,1)=alt)::INT+(substr(gt,2,1)=alt)::INT"


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, STUDY_SQL)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    af = ((F.floor(F.col("pos") / 1000) % 9) / 10.0).alias("pca_af")
    return genotypes(spark, sf_dir).where("ref <> 'G'").select("chrom", "pos", "ref", "alt", af).distinct()


@query(
    "j05_panel_dosages",
    f"""{STUDY}, f AS (SELECT st.*, ref, alt, ROW_NUMBER() OVER (PARTITION BY sample_id, st.chrom, st.pos ORDER BY line_number) AS nth FROM st JOIN pn USING (chrom, pos))
    SELECT sample_id, chrom, pos, ref, alt, CASE WHEN {FITS} THEN {ALTS} END AS dosage FROM f WHERE nth=1""",
)
def panel_dosages(spark, sf_dir):
    return lookups.panel_dosages(study(spark, sf_dir), panel(spark, sf_dir).drop("pca_af"))


@query(
    "j07_loading_dosages",
    f"""{STUDY}, f AS (SELECT st.*, ref, alt, pca_af, ROW_NUMBER() OVER (PARTITION BY sample_id, st.chrom, st.pos ORDER BY line_number DESC) AS nth FROM st JOIN pn USING (chrom, pos) WHERE chrom<>'X' AND gs>=0.15 AND {FITS})
    SELECT sample_id, chrom, pos, ref, alt, pca_af, {ALTS} AS dosage FROM f WHERE nth=1""",
)
def loading_dosages(spark, sf_dir):
    return lookups.loading_dosages(study(spark, sf_dir), panel(spark, sf_dir))


@query(
    "j06_allele_matched",
    f"{STUDY} SELECT DISTINCT rsid, g.chrom, g.pos, g.ref, g.alt, pca_af FROM g JOIN pn ON g.chrom=pn.chrom AND g.pos=pn.pos WHERE pca_af>0 AND g.pos%4000<>0",
)
def allele_matched(spark, sf_dir):
    g, swapped = genotypes(spark, sf_dir), F.col("pos") % 4000 == 0
    variants = g.select("rsid", F.concat(F.lit("chr"), "chrom").alias("chrom"), "pos", F.when(swapped, F.col("ref")).otherwise(F.col("alt")).alias("a1"), F.when(swapped, F.col("alt")).otherwise(F.col("ref")).alias("a2")).distinct()
    return lookups.allele_matched(variants, panel(spark, sf_dir)).select("rsid", "chrom", "pos", "ref", "alt", "pca_af")


@query(
    "j06_m05_matched_projection",
    f"""{STUDY}, m AS (SELECT CAST(COUNT(*) AS DOUBLE) AS m FROM pn), x AS (SELECT d.sample_id, dosage, pca_af AS p, ((d.pos//1000)%17-8)/100.0::DOUBLE AS l FROM d JOIN pn ON d.chrom=pn.chrom AND d.pos=pn.pos AND d.ref=pn.ref AND d.alt=pn.alt WHERE dosage IS NOT NULL AND pca_af>0)
    SELECT sample_id, 1 AS pc, ROUND(SUM((dosage-2*p)*l/SQRT((SELECT m FROM m)*2*p*(1-p))),6) AS score FROM x GROUP BY sample_id""",
)
def matched_projection(spark, sf_dir):
    loads = panel(spark, sf_dir).withColumn("loadings", F.array(((F.floor(F.col("pos") / 1000) % 17) - 8) / 100.0))
    return linalg.project(dosages(spark, sf_dir), loads, ["chrom", "pos", "ref", "alt"]).withColumn("score", F.round("score", 6))


@query(
    "j03_s26_keyed_slices",
    f"{CTE}, k AS (SELECT DISTINCT chrom, pos, ref, alt FROM g) SELECT concat_ws('-', chrom, CAST(pos AS VARCHAR), ref, alt) AS locus_key, CASE WHEN ref<>'G' THEN ((pos//1000)%16)/16.0::DOUBLE END AS af FROM k",
)
def keyed_slices(spark, sf_dir):
    k = genotypes(spark, sf_dir).select("chrom", "pos", "ref", "alt").distinct()
    rows = k.select(G.locus_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("locus_key"), "ref", "pos")
    # Each locus twice, the second row in a later file.
    twice = rows.where("ref <> 'G'").select("locus_key", "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("file"))
    slices = twice.select("locus_key", ((F.floor(F.col("pos") / 1000) % 16) / 16 + F.col("file")).alias("af"), "file", F.lit(0).alias("block"), "pos").withColumnRenamed("pos", "nth")
    return lookups.keyed_slices(rows, lookups.first_slices(slices))


@query(
    "j21_subset",
    f"""{CTE} SELECT sample_id, COUNT(*) AS rows FROM g WHERE pop IN ('north','south') AND sample_id NOT IN (SELECT sample_id FROM g GROUP BY sample_id HAVING COUNT(*) FILTER (gt='--')>COUNT(*)*0.02)
    AND ref<>'G' AND rsid NOT IN (SELECT rsid FROM g WHERE gt='NN') GROUP BY sample_id""",
)
def subset(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    lacking = g.groupBy("sample_id").agg(F.count_if(F.col("gt") == "--").alias("n"), F.count("*").alias("all")).where("n > all * 0.02")
    rows = lookups.subset(g, keep=g.where(F.col("pop").isin("north", "south")), remove=lacking, extract=g.where("ref <> 'G'"), exclude=g.where("gt = 'NN'"))
    return rows.groupBy("sample_id").agg(F.count("*").alias("rows"))


@query("j11_concatenated", f"{CTE} SELECT sample_id, COUNT(*) AS rows, COUNT(*) FILTER (chrom='X') AS x FROM g GROUP BY sample_id")
def concatenated(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    return lookups.concatenated([g.where("chrom <> 'X'"), g.where("chrom = 'X'")]).groupBy("sample_id").agg(F.count("*").alias("rows"), F.count_if(F.col("chrom") == "X").alias("x"))


@query(
    "m10_haploid_males",
    f"""{CTE}, h AS (SELECT rsid, sex, CASE WHEN sex='M' AND chrom='X' THEN (CASE dosage WHEN 0 THEN 0 WHEN 2 THEN 1 END) ELSE dosage END AS dosage, CASE WHEN sex='M' AND chrom='X' THEN 1 ELSE 2 END AS ploidy FROM d)
    SELECT rsid, ploidy, COUNT(dosage) AS calls, CAST(SUM(dosage) AS BIGINT) AS alleles FROM h GROUP BY ALL""",
)
def haploid_males(spark, sf_dir):
    d = dosages(spark, sf_dir)
    rows = ancestry.haploid_males(d.drop("sex"), d.select("sample_id", "sex").distinct())
    return rows.groupBy("rsid", "ploidy").agg(F.count("dosage").alias("calls"), F.sum("dosage").alias("alleles"))


@query(
    "t03_bed_sites",
    f"""{CTE}, k AS (SELECT DISTINCT concat_ws('-', chrom, CAST(pos AS VARCHAR), ref, alt) AS name, chrom, pos, CASE WHEN chrom='X' THEN 23 ELSE CAST(chrom AS INT) END AS code FROM g)
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY code, pos, name) AS INTEGER) AS nth, concat('chr', chrom) AS chrom, pos-1 AS start, pos AS "end", name FROM k""",
)
def bed_sites(spark, sf_dir):
    g = genotypes(spark, sf_dir).select(G.locus_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("locus_key")).distinct()
    return popgen.bed_sites(g)


@query(
    "f13_dropped_with_reasons",
    f"""{VARIANTS}, r AS (SELECT rsid, concat_ws(',', CASE WHEN 1-call_rate>0.30 THEN 'GENO' END, CASE WHEN maf<0.05 THEN 'MAF' END, CASE WHEN chi2>15.136705226623 THEN 'HWE' END) AS reasons FROM x)
    SELECT rsid, CASE WHEN reasons='' THEN 'OTHER' ELSE reasons END AS reasons FROM r WHERE reasons<>'' OR rsid IN (SELECT rsid FROM g WHERE ref='G')""",
)
def dropped_with_reasons(spark, sf_dir):
    d = dosages(spark, sf_dir)
    rows = filters.variant_qc(d, LOOSE)
    survivors = filters.all_reasons(rows, LOOSE).where("reasons = ''").join(d.where("ref = 'G'").select("rsid").distinct(), "rsid", "left_anti")
    return filters.dropped_with_reasons(rows, survivors, LOOSE).select("rsid", "reasons")


@query(
    "f24_canonical_lines",
    f"""{CTE}, k AS (SELECT DISTINCT chrom, pos, rsid FROM g), l AS (SELECT *, CASE pos//1000%5 WHEN 0 THEN concat('chr', chrom) WHEN 1 THEN concat(chrom, '_alt') WHEN 2 THEN 'MT' WHEN 3 THEN 'chr23' ELSE chrom END AS name FROM k)
    SELECT name AS chrom, COUNT(*) AS lines FROM l WHERE pos//1000%5 NOT IN (1,3) GROUP BY name""",
)
def canonical_lines(spark, sf_dir):
    k, of = genotypes(spark, sf_dir).select("chrom", "pos", "rsid").distinct(), F.floor(F.col("pos") / 1000) % 5
    name = F.when(of == 0, F.concat(F.lit("chr"), "chrom")).when(of == 1, F.concat("chrom", F.lit("_alt"))).when(of == 2, "MT").when(of == 3, "chr23").otherwise(F.col("chrom"))
    lines = k.select(F.concat_ws("\t", name, F.col("pos").cast("string"), "rsid").alias("value"))
    kept = vcf.canonical_lines(lines.unionByName(spark.createDataFrame([("#CHROM\tPOS",)], "value string")))
    return kept.where(~F.col("value").startswith("#")).groupBy(F.split_part("value", F.lit("\t"), F.lit(1)).alias("chrom")).agg(F.count("*").alias("lines"))


@query("y03_bias_blocks")
def bias_blocks(spark, sf_dir):
    g = genotypes(spark, sf_dir).select("rsid", "chrom", "pos", "ref").distinct()
    return synth.bias_blocks(g, g.where("ref = 'A'"), ["a", "b"], 30, 40, 5, 20, 3)


@query("m10_cross_validation")
def cross_validation(spark, sf_dir):
    return ancestry.cross_validated(dosages(spark, sf_dir), [2, 3]).select("k", "rep", F.round("cv", 6).alias("cv"))


@query("m11_headline_and_females")
def headline_and_females(spark, sf_dir):
    d = dosages(spark, sf_dir)
    return ancestry.headline_and_females(d, d.select("sample_id", "sex").distinct(), 2)
