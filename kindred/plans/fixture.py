"""Genotypes derived from the driver's tables by whole-number arithmetic that Spark and DuckDB agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows ``(sample_id, pop, sex, chrom, pos, rsid, ref, alt, gt, gs)``, one a sample and variant at most. Every order line is
#: a call: suppliers are dealt to samples, of which there are five times the root of the suppliers, and a sample's lines
#: are its variants in order. So samples and variants grow with the tables, and those with fewer lines lack the last ones.
GENOTYPES_SQL = """
SELECT sample_id, pop, sex, chrom, pos, rsid, ref, alt, CASE WHEN nocall THEN '--' ELSE concat(a1, a2) END AS gt, gs
FROM (
  SELECT b.*,
    CASE WHEN rare THEN 'N' WHEN u1 < thr THEN alt ELSE ref END AS a1,
    CASE WHEN rare THEN 'N' WHEN sex = 'M' AND chrom = 'X' THEN (CASE WHEN u1 < thr THEN alt ELSE ref END) WHEN u2 < thr THEN alt ELSE ref END AS a2
  FROM (
    SELECT CAST(s AS INT) AS sample_id,
      CASE s % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'east' ELSE 'west' END AS pop,
      CASE WHEN (s * 7 + 3) % 5 < 2 THEN 'M' ELSE 'F' END AS sex,
      CASE WHEN v % 10 = 9 THEN 'X' ELSE CAST(v % 10 + 1 AS VARCHAR(3)) END AS chrom,
      CAST(v * 1000 + 1000 AS BIGINT) AS pos,
      concat('rs', CAST(v + 1 AS VARCHAR(8))) AS rsid,
      CASE v % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'C' WHEN 4 THEN 'A' ELSE 'G' END AS ref,
      CASE v % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'T' WHEN 2 THEN 'T' WHEN 3 THEN 'G' WHEN 4 THEN 'C' ELSE 'T' END AS alt,
      (k * 31 + n * 17) % 100 AS u1, (k * 53 + n * 29 + 11) % 100 AS u2,
      (v * 37) % 90 + (s % 4) * 3 AS thr,
      (k * 13 + n * 7) % 50 = 0 AS nocall, (k * 19 + n * 3) % 211 = 0 AS rare,
      CAST((k + n) % 100 AS DOUBLE) / 100.0 AS gs
    FROM (SELECT s, k, n, ROW_NUMBER() OVER (PARTITION BY s ORDER BY k, n, p, q, x) - 1 AS v
      FROM (SELECT l_suppkey % (SELECT 5 * CAST(CEIL(SQRT(COUNT(*))) AS BIGINT) FROM supplier) AS s, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, l_extendedprice AS x FROM lineitem) l0) l1
  ) b
) c"""


#: Where lines are dealt to samples, and how many a partition of samples is meant to hold.
DEALT, PARTITION_ROWS = "(SELECT l_suppkey % (", 100_000


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, GENOTYPES_SQL)


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A query over tables of ``sf_dir`` by name, without leaving views behind."""
    names = tables or ("lineitem", "supplier")
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    if DEALT in text:  # as many partitions of samples as the lines need, whatever the session's setting
        parts = max(spark.sparkContext.defaultParallelism, -(-found["lineitem"].count() // PARTITION_ROWS))
        text = text.replace(DEALT, DEALT.replace("SELECT", f"SELECT /*+ REPARTITION({parts}, s) */"))
    text = text.replace("{", "{{").replace("}", "}}")
    for t in names:
        text = text.replace(f" {t}", f" {{{t}}}")
    return spark.sql(text, **found)


#: Raw lines of genotype files, some of them malformed, with a number in each file.
LINES_SQL = """
SELECT concat('p', CAST(sample_id AS VARCHAR(4))) AS participant_id, concat('/data/p', CAST(sample_id AS VARCHAR(4)), '/a.txt') AS file, CAST(line_number AS INT) AS line_number,
  CASE WHEN line_number % 29 = 0 THEN concat_ws(',', rsid, chrom, gt)
       WHEN line_number % 31 = 0 THEN concat_ws('\t', rsid, 'chr0', CAST(pos AS VARCHAR(12)), gt, gst, '0.5', '')
       WHEN line_number % 37 = 0 THEN concat_ws('\t', rsid, chrom, 'abc', gt, 'x', '0.5', '0.1')
       WHEN line_number % 41 = 0 THEN concat_ws('\t', rsid, chrom, CAST(pos AS VARCHAR(12)), '#N/A', gst, '0.5', '0.1')
       WHEN line_number % 43 = 0 THEN concat_ws('\t', 'rs1', '7', CAST(pos AS VARCHAR(12)), 'AG', gst, 'nan', '0.1')
       WHEN line_number % 47 = 0 THEN concat_ws('\t', '.', concat('Chr', chrom), CAST(pos AS VARCHAR(12)), lower(gt), gst, '0.5', '0.1', 'more')
       WHEN line_number % 53 = 0 THEN '# a comment'
       WHEN line_number % 59 = 0 THEN concat_ws('\t', substr(rsid, 3), chrom, '0', 'QQ', gst, '0.5', '0.1')
       ELSE concat_ws('\t', rsid, chrom, CAST(pos AS VARCHAR(12)), gt, gst, '0.5', '0.1') END AS line
FROM (SELECT r.*, CASE WHEN gs < 0.05 THEN '' ELSE '0.75' END AS gst, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY pos) AS line_number FROM genotypes r) w"""


def lines_sql() -> str:
    return LINES_SQL.replace("genotypes r", f"({GENOTYPES_SQL}) r")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, lines_sql())


#: Calls of genes by participant: customers are participants, nations countries.
CALLS_SQL = """
SELECT concat('c', CAST(c.c_custkey AS VARCHAR(12))) AS participant_id, n.n_name AS country, concat('GENE', CAST(x.k AS VARCHAR(2))) AS gene,
  CASE (c.c_custkey * 7 + x.k * 3) % 17 WHEN 0 THEN '*1/*1' WHEN 1 THEN '*1/*2' WHEN 2 THEN '*2/*2' WHEN 3 THEN '' WHEN 4 THEN 'Reference/Reference' WHEN 5 THEN '*1/*4 (0.9)' WHEN 6 THEN 'No Call' WHEN 7 THEN 'NA' WHEN 8 THEN ' n/a ' WHEN 9 THEN 'None'
    WHEN 10 THEN 'b (Reference)/B  (reference)' WHEN 11 THEN 'rs12 reference (A)/rs12 reference (G)' WHEN 12 THEN 'rs12 reference (A)/rs12 variant (G)' WHEN 13 THEN 'ref/ref' WHEN 14 THEN '*1/*1 (0.9)' WHEN 15 THEN 'Wild-type/Wild-type' ELSE '*1/*10' END AS diplotype,
  CASE (c.c_custkey * 7 + x.k * 3) % 6 WHEN 0 THEN 'normal' WHEN 3 THEN '' ELSE 'poor' END AS phenotype,
  CASE c.c_custkey % 3 WHEN 0 THEN 'chr1:100:A>G' WHEN 1 THEN '' ELSE 'chr1:100:A>G;chr1:200:C>T' END AS raw_alleles
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) x
WHERE (c.c_custkey + x.k) % 5 <> 0"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CALLS_SQL, "customer", "nation")


#: Ancestry proportions of samples: three components that add up to 1, on autosomes and on the X.
PROPORTIONS_SQL = """
SELECT CAST(s.c_custkey AS BIGINT) AS sample_id, k.component, k.region,
  CASE WHEN s.c_custkey % 4 = 3 THEN NULL WHEN s.c_custkey % 4 = 0 THEN 'AFR' WHEN s.c_custkey % 4 = 1 THEN 'EUR' ELSE 'SAS' END AS superpopulation,
  CASE WHEN s.c_custkey % 2 = 0 THEN '1' ELSE '2' END AS sex,
  CAST(CASE WHEN s.c_custkey % 4 = k.component THEN 60 + (s.c_custkey + k.shift) % 20 ELSE 10 + (s.c_custkey * 3 + k.component + k.shift) % 9 END AS DOUBLE) / 100.0 AS q
FROM customer s CROSS JOIN (
  SELECT 0 AS component, 'auto' AS region, 0 AS shift UNION ALL SELECT 1, 'auto', 0 UNION ALL SELECT 2, 'auto', 0
  UNION ALL SELECT 0, 'x', 5 UNION ALL SELECT 1, 'x', 5 UNION ALL SELECT 2, 'x', 5) k"""


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PROPORTIONS_SQL, "customer")
