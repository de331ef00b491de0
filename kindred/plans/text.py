"""Raw genotype lines: canonical rows, issues and run reports; scalar normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import labels as L
from ..operators import qc
from ..sources import tables, text
from ..sources.shared import written
from .fixture import GENOTYPES_SQL, genotypes, lines, lines_sql, sql
from .registry import query

TAB = "chr(9)"
ROWS = f"""WITH l AS ({lines_sql()}),
p AS (SELECT participant_id, file, line_number, line, string_split(line, {TAB}) AS p FROM l WHERE trim(line)<>'' AND line NOT LIKE '#%'),
f AS (SELECT *, len(p) AS n, trim(p[1]) AS rsid, upper(regexp_replace(trim(p[2]),'^[cC][hH][rR]','')) AS chrom, trim(p[3]) AS ps, trim(p[4]) AS gt0, upper(trim(p[4])) AS g, trim(p[5]) AS gs0, trim(p[6]) AS b0, trim(p[7]) AS r0 FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(ps,'^[+-]?[0-9]{{1,18}}$') THEN CAST(ps AS BIGINT) END AS pos,
  CASE WHEN g IN ('','-','--','.','0','00','N','NN','NA','N/A','#N/A') THEN 'no_call' WHEN regexp_matches(g,'^[ACGT][ACGT]$') THEN 'snp' WHEN regexp_matches(g,'^[ACGTID][ACGTID]$') THEN 'indel' ELSE 'invalid' END AS kind FROM f)"""
CHROMS = ",".join(f"'{c}'" for c in G.CHROMOSOMES_WITH_PAR)


@query(
    "s03_x11_canonical_rows",
    f"""{ROWS}, c AS (SELECT participant_id, line_number, CASE WHEN rsid IN ('.','-') THEN '' WHEN lower(rsid) LIKE 'rs%' THEN rsid ELSE concat('rs',rsid) END AS rsid, chrom, pos,
    CASE WHEN g IN ('','-','.','N','0','NA','N/A','#N/A') OR regexp_matches(g,'^[-.N0]+$') THEN '--' ELSE g END AS gt, TRY_CAST(NULLIF(gs0,'') AS DOUBLE) AS gs FROM k WHERE n>=7 AND rsid<>'' AND gt0 NOT IN ('#N/A','#n/a'))
    SELECT participant_id, CAST(line_number AS INTEGER) AS line_number, CASE WHEN rsid<>'' THEN rsid ELSE concat(chrom,':',CAST(pos AS VARCHAR)) END AS variant_id, chrom, pos, gt, CASE WHEN gs='nan' THEN NULL ELSE gs END AS gs
    FROM c WHERE pos>0 AND chrom IN ({CHROMS}) AND (gt IN ('--','II','ID','DI','DD') OR regexp_matches(gt,'^[ACGT][ACGT]$'))""",
)
def canonical_rows(spark, sf_dir):
    return text.ddna(lines(spark, sf_dir)).select("participant_id", "line_number", "variant_id", "chrom", "pos", "gt", "gs")


@query(
    "w05_g30_replicates",
    f"""WITH g AS ({GENOTYPES_SQL}), r AS (SELECT concat('p', CAST(sample_id AS VARCHAR)) AS participant_id, pos AS line_number, concat('v', CAST((pos//1000)%40 AS VARCHAR)) AS variant_id, gt FROM g),
    c AS (SELECT *, COUNT(DISTINCT gt) FILTER (gt<>'--') OVER (PARTITION BY participant_id, variant_id) AS k, ROW_NUMBER() OVER (PARTITION BY participant_id, variant_id ORDER BY (gt='--')::INT DESC, line_number DESC) AS n FROM r)
    SELECT participant_id, variant_id, line_number, CASE WHEN k>1 THEN '--' ELSE gt END AS gt FROM c WHERE n=1""",
)
def replicates(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    rows = g.select(F.concat(F.lit("p"), F.col("sample_id").cast("string")).alias("participant_id"), F.lit("f").alias("file"), F.col("pos").alias("line_number"), F.concat(F.lit("v"), (F.floor(F.col("pos") / 1000) % 40).cast("string")).alias("variant_id"), "gt")
    return text.merge_replicates(rows).drop("file")


NUM = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$'"
ODD = "'^[+-]?(nan|inf|infinity)$'"


def _numbers() -> str:
    out = []
    for name, c, excused in (("GS", "gs0", "false"), ("BAF", "b0", "kind='no_call'"), ("LRR", "r0", "kind='no_call'")):
        out += [
            f"SELECT 'WARNING', 'MISSING_{name}' FROM s WHERE {c}=''",
            f"SELECT 'WARNING', 'INVALID_{name}' FROM s WHERE {c}<>'' AND NOT regexp_matches(lower({c}),{ODD}) AND NOT regexp_matches({c},{NUM})",
            f"SELECT 'WARNING', 'NONFINITE_{name}' FROM s WHERE regexp_matches(lower({c}),{ODD}) AND NOT ({excused})",
        ]
    return " UNION ALL ".join(out)


ISSUES = f"""{ROWS}, s AS (SELECT * FROM k WHERE n>=7 AND gt0 NOT IN ('#N/A','#n/a')),
w AS (SELECT *, ROW_NUMBER() OVER q AS nth, FIRST_VALUE(chrom) OVER q AS c1, FIRST_VALUE(ps) OVER q AS p1, FIRST_VALUE(g) OVER q AS g1, FIRST_VALUE(kind) OVER q AS k1 FROM s WHERE rsid NOT IN ('','.','-') WINDOW q AS (PARTITION BY file, rsid ORDER BY line_number)),
i AS (SELECT 'ERROR' AS severity, 'POSSIBLE_CSV' AS code FROM k WHERE n=1 AND contains(line, ',') UNION ALL SELECT 'ERROR', 'DDNA_FIELD_COUNT' FROM k WHERE n<7
 UNION ALL SELECT 'QUALITY', 'DDNA_VENDOR_NO_CALL_ROW' FROM k WHERE n>=7 AND gt0 IN ('#N/A','#n/a') UNION ALL SELECT 'QUALITY', 'UNMAPPED_CHROM' FROM s WHERE chrom='0'
 UNION ALL SELECT 'ERROR', 'INVALID_CHROM' FROM s WHERE chrom<>'0' AND chrom NOT IN ({CHROMS}) UNION ALL SELECT 'ERROR', 'INVALID_POSITION' FROM s WHERE pos IS NULL
 UNION ALL SELECT 'QUALITY', 'UNMAPPED_POSITION' FROM s WHERE pos<=0 UNION ALL SELECT 'ERROR', 'MISSING_GENOTYPE' FROM s WHERE gt0='' UNION ALL SELECT 'ERROR', 'INVALID_GENOTYPE' FROM s WHERE gt0<>'' AND kind='invalid'
 UNION ALL {_numbers()}
 UNION ALL SELECT 'WARNING', 'DUPLICATE_RSID' FROM w WHERE nth>1 AND chrom=c1 AND ps=p1 AND g=g1
 UNION ALL SELECT CASE WHEN kind='indel' OR k1='indel' THEN 'QUALITY' ELSE 'ERROR' END, 'CONFLICTING_DUPLICATE_RSID' FROM w WHERE nth>1 AND NOT (chrom=c1 AND ps=p1 AND g=g1))"""


@query("f01_ddna_issues", f"{ISSUES} SELECT severity, code, COUNT(*) AS issues FROM i GROUP BY ALL")
def ddna_issues(spark, sf_dir):
    return qc.ddna_issues(lines(spark, sf_dir)).groupBy("severity", "code").agg(F.count("*").alias("issues"))


@query("f03_structural", f"{ROWS} SELECT 'few_fields' AS problem, COUNT(*) AS lines FROM k WHERE n<7 UNION ALL SELECT 'looks_like_csv', COUNT(*) FROM k WHERE n=1 AND contains(line, ',')")
def structural(spark, sf_dir):
    return qc.structural(lines(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("lines"))


BAD = f"""{ROWS}, s AS (SELECT * FROM k WHERE n>=7 AND gt0 NOT IN ('#N/A','#n/a')), w AS (SELECT *, ROW_NUMBER() OVER q AS nth, FIRST_VALUE(chrom) OVER q AS c1, FIRST_VALUE(ps) OVER q AS p1, FIRST_VALUE(g) OVER q AS g1 FROM s WHERE rsid NOT IN ('','.','-') WINDOW q AS (PARTITION BY file, rsid ORDER BY line_number)),
b AS (SELECT file, line_number FROM k WHERE n<7 UNION SELECT file, line_number FROM s WHERE (chrom<>'0' AND chrom NOT IN ({CHROMS})) OR pos IS NULL OR gt0='' OR kind='invalid' UNION SELECT file, line_number FROM w WHERE nth>1 AND NOT (chrom=c1 AND ps=p1 AND g=g1))"""


#: Files by their number: of three one is clean, one has lines that are warned of, one all kinds of lines.
NUMBER = "CAST(substr(participant_id, 2) AS INT) % 3"
CLEAN = "line_number % 29 <> 0 AND line_number % 37 <> 0 AND line_number % 43 <> 0 AND line_number % 59 <> 0"
TIDY = f"{CLEAN} AND line_number % 31 <> 0 AND line_number % 41 <> 0 AND line NOT LIKE '%		%'"
SORTED = f"({NUMBER} = 2 OR ({NUMBER} = 1 AND {CLEAN}) OR ({NUMBER} = 0 AND {TIDY}))"
FEWER = BAD.replace("WHERE trim(line)<>''", f"WHERE {SORTED} AND trim(line)<>''", 1)


def sorted_files(spark, sf_dir):
    """Lines of files of three kinds, all issues in them, and the files, of which some have no line."""
    rows = written(lines(spark, sf_dir).where(SORTED))
    files = rows.select("participant_id", "file").distinct().withColumn("bytes", F.lit(9))
    empty = files.where(f"{NUMBER} = 0").select("participant_id", F.concat("file", F.lit(".empty")).alias("file"), F.lit(0).alias("bytes"))
    files = files.unionByName(empty)
    return files, qc.ddna_issues(rows).unionByName(qc.file_issues(files, rows))


@query(
    "g14_run_report",
    f"""{FEWER}, n AS (SELECT COUNT(DISTINCT file) AS n, COUNT(DISTINCT file) FILTER ({NUMBER} = 0) AS e FROM l)
    SELECT (SELECT n+e FROM n) AS files, (SELECT e FROM n) AS files_with_file_errors, COUNT(DISTINCT file) AS files_with_row_errors, COUNT(*) AS bad_lines, (SELECT ROUND(100.0::DOUBLE*n/(n+e),2) FROM n) AS usable_percent FROM b""",
)
def run_report(spark, sf_dir):
    return qc.run_report(*sorted_files(spark, sf_dir))


@query(
    "g16_file_status",
    f"""{FEWER} SELECT file, CASE WHEN file IN (SELECT file FROM b) THEN 'FAIL' WHEN file IN (SELECT file FROM k WHERE n>=7 AND (line_number%31=0 OR gs0='' OR gt0 IN ('#N/A','#n/a'))) THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT DISTINCT file FROM p)
    UNION ALL SELECT DISTINCT concat(file, '.empty'), 'FAIL' FROM l WHERE {NUMBER} = 0""",
)
def file_status(spark, sf_dir):
    return qc.file_status(*sorted_files(spark, sf_dir)).select("file", "status")


@query("g15_row_errors", f"{BAD} SELECT file, COUNT(*) AS lines FROM b GROUP BY file")
def row_errors(spark, sf_dir):
    return qc.split_errors(qc.ddna_issues(lines(spark, sf_dir)))[1].groupBy("file").agg(F.count_distinct("line_number").alias("lines"))


@query(
    "s01_s02_sniffed",
    f"WITH l AS ({lines_sql()}) SELECT DISTINCT file, CASE WHEN {NUMBER}=0 THEN 'illumina' ELSE 'ddna' END AS format, CASE WHEN {NUMBER}=1 THEN ',' ELSE chr(9) END AS delimiter FROM l",
)
def sniffed(spark, sf_dir):
    # Of three files one begins with a blank and the mark of a report, one has commas, one tabs.
    line = F.when((F.expr(NUMBER) == 0) & (F.col("line_number") == 1), " ").when((F.expr(NUMBER) == 0) & (F.col("line_number") == 2), "[Header]")
    rows = lines(spark, sf_dir).withColumn("line", line.when(F.expr(NUMBER) == 1, F.translate("line", "\t", ",")).otherwise(F.col("line")))
    return text.sniff(rows).join(text.delimiter(rows), "file")


@query("g17_facet_counts", "WITH c AS (SELECT 'segment' AS facet, c_mktsegment AS v FROM customer UNION ALL SELECT 'nation', CASE WHEN c_nationkey%5=0 THEN ' N/A ' ELSE concat('n', CAST(c_nationkey AS VARCHAR)) END FROM customer) SELECT facet, CASE WHEN lower(trim(v)) IN ('','na','n/a','null','none','nan','.') THEN '<MISSING>' ELSE trim(v) END AS value, COUNT(*) AS count FROM c GROUP BY ALL")
def facet_counts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = F.when(F.col("c_nationkey") % 5 == 0, " N/A ").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return qc.facet_counts(c.select(F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), nation).alias("facets")))


@query("x23_missing_facets", "SELECT CAST(c_custkey AS BIGINT) AS id, concat_ws(',', CASE WHEN c_nationkey%3=0 THEN 'a' END, CASE WHEN c_nationkey%4=0 THEN 'b' END) AS missing FROM customer")
def missing_facets(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    m = F.create_map(F.lit("b"), F.when(F.col("c_nationkey") % 4 == 0, ".").otherwise("x"), F.lit("a"), F.when(F.col("c_nationkey") % 3 == 0, "none").otherwise("y"))
    return c.select(F.col("c_custkey").cast("long").alias("id"), L.missing_facets(m).alias("missing"))


TOKENS = "SELECT DISTINCT rsid, chrom, pos, ref, alt, gt, concat(CASE WHEN pos%3000=0 THEN 'chr' WHEN pos%5000=0 THEN ' CHR' ELSE '' END, chrom) AS raw_chrom, CASE WHEN pos%7000=0 THEN '.' WHEN pos%11000=0 THEN '' WHEN pos%4000=0 THEN substr(rsid,3) ELSE upper(rsid) END AS raw_id FROM g"


@query(
    "x01_x10_normalised_fields",
    f"""WITH g AS ({GENOTYPES_SQL}), t AS ({TOKENS}) SELECT rsid, gt, upper(regexp_replace(trim(raw_chrom),'^(chr|CHR)','')) AS chrom, CASE WHEN chrom='X' THEN 23 ELSE CAST(chrom AS INTEGER) END AS plink,
    CASE WHEN raw_id IN ('','.') THEN '' WHEN lower(raw_id) LIKE 'rs%' THEN raw_id ELSE concat('rs',raw_id) END AS id, CASE WHEN raw_id IN ('','.') OR lower(raw_id) NOT LIKE 'rs%' THEN '' ELSE concat('rs',substr(raw_id,3)) END AS extracted,
    CASE WHEN gt IN ('--','NN') THEN '--' ELSE gt END AS genotype, CASE WHEN gt IN ('--','NN') THEN 'no_call' ELSE 'snp' END AS kind, CASE WHEN gt NOT IN ('--','NN') THEN (substr(gt,1,1)<>substr(gt,2,1))::INT END AS signal,
    concat(LEAST(ref,alt),GREATEST(ref,alt)) IN ('AT','CG') AS ambiguous, concat_ws('-',chrom,CAST(pos AS VARCHAR),ref,alt) AS locus_key FROM t""",
)
def normalised_fields(spark, sf_dir):
    n, pos = F.col, F.col("pos")
    raw_chrom = F.concat(F.when(pos % 3000 == 0, "chr").when(pos % 5000 == 0, " CHR").otherwise(""), n("chrom"))
    raw_id = F.when(pos % 7000 == 0, ".").when(pos % 11000 == 0, "").when(pos % 4000 == 0, F.substring("rsid", 3, 20)).otherwise(F.upper("rsid"))
    t = genotypes(spark, sf_dir).select("rsid", "chrom", "pos", "ref", "alt", "gt", raw_chrom.alias("raw_chrom"), raw_id.alias("raw_id")).distinct()
    return t.select(
        "rsid", "gt", G.clean_chrom(n("raw_chrom")).alias("chrom"), G.plink_chrom(n("raw_chrom")).alias("plink"), G.canonical_rsid(n("raw_id")).alias("id"), G.extract_rsid(n("raw_id")).alias("extracted"), G.genotype(n("gt")).alias("genotype"),
        G.genotype_class(n("gt")).alias("kind"), G.signal(n("gt")).alias("signal"), G.ambiguous(n("ref"), n("alt")).alias("ambiguous"), G.locus_key(n("chrom"), pos, n("ref"), n("alt")).alias("locus_key"),
    )


@query(
    "x19_x20_labels",
    """SELECT n_name, trim(regexp_replace(lower(trim(n_name)),'[^a-z0-9]+','_','g'),'_') AS population, CASE WHEN n_nationkey%4=0 THEN 'M' WHEN n_nationkey%4=1 THEN 'F' WHEN n_nationkey%4=2 THEN 'M' END AS sex,
    regexp_replace(n_name,'[^A-Za-z0-9._-]+','_','g') AS safe FROM nation""",
)
def label_fields(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, " Male").when(k == 1, "2").when(k == 2, "m").otherwise("?")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", L.population(F.col("n_name")).alias("population"), L.sex(raw).alias("sex"), L.safe_id(F.col("n_name")).alias("safe"))


#: Numbers of lines in an order of all rows, and what orders them the same way without one task that numbers them.
NUMBERED = "ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
PLACE = "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

#: A frequency file's rows, in order: keys of both kinds, some of another spelling, repeated, of no variant or malformed.
AF_FILE = f"""SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_number, CASE l_linenumber % 7 WHEN 0 THEN 'no key' WHEN 1 THEN concat('chr', chrom, ':', pos, ':', lower(ref), ':', alt) WHEN 2 THEN concat(chrom, '-', pos, '-', ref, '-', lower(alt))
    WHEN 3 THEN concat(chrom, ':', pos, ':', alt, ':', ref) WHEN 4 THEN concat(chrom, ':x:', ref, ':', alt) ELSE concat(chrom, ':', pos, ':', ref, ':', alt) END AS locus_key,
  CASE WHEN l_quantity < 6 THEN 'n' ELSE CAST(CAST(l_quantity AS INT) * 2 AS VARCHAR(4)) END AS allele_number, CAST(CAST(l_quantity AS DOUBLE) / 64 AS VARCHAR(12)) AS allele_freq
  FROM (SELECT l.*, g.chrom, g.pos, g.ref, g.alt FROM lineitem l JOIN (SELECT DISTINCT chrom, pos, ref, alt FROM ({GENOTYPES_SQL}) g0) g ON (l_partkey % 700) * 1000 + 1000 = g.pos) x"""
AF_KEYS = f"""WITH v AS (SELECT DISTINCT chrom, pos, ref, alt FROM ({GENOTYPES_SQL}) g), a AS ({AF_FILE}),
  p AS (SELECT *, CASE WHEN contains(locus_key,':') THEN string_split(locus_key,':') ELSE string_split(locus_key,'-') END AS p FROM a),
  k AS (SELECT line_number, TRY_CAST(allele_number AS BIGINT) AS n, CAST(allele_freq AS DOUBLE) AS f, CASE WHEN len(p)=4 THEN regexp_replace(p[1],'^chr','') END AS chrom, TRY_CAST(p[2] AS BIGINT) AS pos, upper(p[3]) AS ref, upper(p[4]) AS alt FROM p),
  m AS (SELECT k.*, v.chrom IS NOT NULL AS known, ROW_NUMBER() OVER (PARTITION BY k.chrom, k.pos, k.ref, k.alt ORDER BY line_number) AS nth FROM k LEFT JOIN v ON k.chrom=v.chrom AND k.pos=v.pos AND k.ref=v.ref AND k.alt=v.alt)"""


def frequency_file(spark, sf_dir):
    return sql(spark, sf_dir, AF_FILE.replace(NUMBERED, PLACE), "lineitem", "supplier"), genotypes(spark, sf_dir).select("chrom", "pos", "ref", "alt").distinct()


@query(
    "s18_keyed_af",
    f"""{AF_KEYS} SELECT v.chrom, v.pos, v.ref, v.alt, CASE WHEN n IS NOT NULL THEN f END AS allele_freq, coalesce(n, 0) AS allele_number
    FROM v LEFT JOIN (SELECT * FROM m WHERE nth=1 AND known) m ON m.chrom=v.chrom AND m.pos=v.pos AND m.ref=v.ref AND m.alt=v.alt""",
)
def keyed_af(spark, sf_dir):
    return tables.keyed_af(*frequency_file(spark, sf_dir))[0]


@query(
    "s18_counts",
    f"""{AF_KEYS} SELECT COUNT(*) AS rows, COUNT(*) FILTER (known AND nth=1 AND n IS NOT NULL) AS matched, COUNT(*) FILTER (NOT known OR (nth=1 AND n IS NULL)) AS unmatched, COUNT(*) FILTER (known AND nth>1) AS duplicates FROM m""",
)
def keyed_counts(spark, sf_dir):
    return tables.keyed_af(*frequency_file(spark, sf_dir))[1]


@query(
    "s22_loadings",
    """WITH l AS (SELECT CAST(l_partkey % 23 AS VARCHAR) AS chrom, l_suppkey AS pos, CASE l_linenumber % 2 WHEN 0 THEN 'A' ELSE 'G' END AS ref, 'T' AS alt, CAST(l_quantity AS DOUBLE) AS pca_af, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem)
    SELECT chrom, pos, arg_min(ref, nth) AS ref, arg_min(alt, nth) AS alt, arg_min(pca_af, nth) AS pca_af FROM l GROUP BY chrom, pos""",
)
def loadings(spark, sf_dir):
    l = sql(spark, sf_dir, f"SELECT CAST(l_partkey % 23 AS STRING) AS chrom, l_suppkey AS pos, CASE l_linenumber % 2 WHEN 0 THEN 'A' ELSE 'G' END AS ref, 'T' AS alt, CAST(l_quantity AS DOUBLE) AS pca_af, {PLACE} AS nth FROM lineitem", "lineitem")  # noqa: E741
    return tables.loadings(l.withColumn("loadings", F.array("pca_af"))).drop("loadings")


VCF_CALLS = ("0/0", "0|1", "1/1:9", "./.", "0/2", "1", "0/0/1", "1|0:.:3")


@query(
    "x14_vcf_dosage",
    f"""WITH g AS ({GENOTYPES_SQL}), t AS (SELECT rsid, {list(VCF_CALLS)}[1 + CAST((pos // 1000 + sample_id) % {len(VCF_CALLS)} AS INT)] AS gt FROM g)
    SELECT rsid, gt, CASE gt WHEN '0/0' THEN 0 WHEN '0|1' THEN 1 WHEN '1|0:.:3' THEN 1 WHEN '1/1:9' THEN 2 END AS dosage, COUNT(*) AS calls FROM t GROUP BY ALL""",
)
def vcf_dosage(spark, sf_dir):
    call = F.get(F.array(*map(F.lit, VCF_CALLS)), ((F.floor(F.col("pos") / 1000) + F.col("sample_id")) % len(VCF_CALLS)).cast("int"))
    rows = genotypes(spark, sf_dir).select("rsid", call.alias("gt"))
    return rows.groupBy("rsid", "gt", G.vcf_dosage(F.col("gt")).alias("dosage")).agg(F.count("*").alias("calls"))



@query(
    "g18_summary",
    f"""WITH g AS ({GENOTYPES_SQL}) SELECT COUNT(*) AS rows, COUNT(DISTINCT rsid) AS variants, COUNT(DISTINCT rsid) AS rsids, COUNT(*) FILTER (gt='--') AS no_calls, CAST(0 AS BIGINT) AS by_locus FROM g""",
)
def summary(spark, sf_dir):
    return text.summary(genotypes(spark, sf_dir).withColumn("variant_id", F.col("rsid")))


@query(
    "g18_comparison",
    f"""WITH g AS ({GENOTYPES_SQL}), a AS (SELECT rsid FROM g WHERE pop='north'), b AS (SELECT rsid FROM g WHERE pop='south' AND gt<>'--')
    SELECT (SELECT COUNT(*) FROM a) AS left_rows, (SELECT COUNT(*) FROM b) AS right_rows, (SELECT COUNT(*) FROM (SELECT rsid FROM a INTERSECT SELECT rsid FROM b)) AS shared,
    (SELECT COUNT(*) FROM (SELECT rsid FROM a EXCEPT SELECT rsid FROM b)) AS left_only, (SELECT COUNT(*) FROM (SELECT rsid FROM b EXCEPT SELECT rsid FROM a)) AS right_only""",
)
def comparison(spark, sf_dir):
    g = genotypes(spark, sf_dir).withColumn("variant_id", F.col("rsid"))
    return text.comparison(g.where("pop = 'north'"), g.where("pop = 'south' and gt <> '--'"))


@query(
    "x33_probes",
    """SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey%3<>0 AS has_rsid, p_partkey%3=1 AS plain_rsid, p_partkey%3=2 AS prefixed_or_suffixed, p_partkey%3=0 AS non_rsid, p_partkey%3=2 AND p_partkey%2=0 AS duplicate_probe, p_partkey%3=0 AS cnv_probe, p_partkey%5=0 AS unmapped FROM part""",
)
def probes(spark, sf_dir):
    k, name = F.col("p_partkey"), F.concat(F.lit("rs"), F.col("p_partkey").cast("string"))
    probe = F.when(k % 3 == 1, name).when(k % 3 == 0, "CNV_x").otherwise(F.concat(F.lit("GSA-"), name, F.when(k % 2 == 0, "_ilmndup1").otherwise("_b")))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.cast("long").alias("id"), probe.alias("probe_id"), F.when(k % 5 == 0, "0").otherwise("7").alias("chrom"), F.lit(4).alias("pos"))
    return text.probes(p).drop("probe_id", "chrom", "pos", "rsid")
