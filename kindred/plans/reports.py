"""Frequencies by country."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import popgen, reports, synth
from ..sources import tables
from ..sources.shared import scratch
from .fixture import CALLS_SQL, GENOTYPES_SQL, calls, genotypes, sql
from .registry import query

C = f"WITH c AS ({CALLS_SQL})"
#: Whether a diplotype ``t``, trimmed and in lower case with single spaces, is a no-call or the reference.
REFERENCE = r"""(t <> '' AND (t IN ('no call', 'none', 'na', 'n/a') OR regexp_matches(t, '^reference/reference$') OR regexp_matches(t, '^\*1/\*1$')
  OR regexp_matches(t, '^b \(reference\)/b \(reference\)$') OR regexp_matches(t, '^rs\d+ reference \([acgt]\)/rs\d+ reference \([acgt]\)$')))"""
REFERENCE_CTE = rf"{C}, t AS (SELECT *, regexp_replace(lower(trim(diplotype)), '\s+', ' ', 'g') AS t FROM c)"
FREQ = "ROUND(CAST(n AS DOUBLE)/NULLIF(sample_count,0),6)"


@query(
    "g19_call_frequencies",
    f"""{C}, k AS (SELECT country, gene, phenotype, diplotype, COUNT(*) AS n FROM c GROUP BY ALL), s AS (SELECT country, gene, COUNT(DISTINCT participant_id) AS sample_count FROM c GROUP BY ALL)
    SELECT country, gene, phenotype, diplotype, n AS count, sample_count, {FREQ} AS frequency FROM k JOIN s USING (country, gene)""",
)
def call_frequencies(spark, sf_dir):
    return reports.call_frequencies(calls(spark, sf_dir), ["phenotype", "diplotype"])


@query(
    "g20_genotype_summary",
    f"""{C}, r AS (SELECT * FROM c WHERE diplotype<>''), k AS (SELECT country, gene, diplotype AS genotype, phenotype, COUNT(*) AS n FROM r GROUP BY ALL), s AS (SELECT country, gene, COUNT(DISTINCT participant_id) AS sample_count FROM r GROUP BY ALL)
    SELECT country, gene, genotype, phenotype, n AS count, sample_count, {FREQ} AS frequency FROM k JOIN s USING (country, gene)""",
)
def genotype_summary(spark, sf_dir):
    return reports.genotype_summary(calls(spark, sf_dir).withColumnRenamed("diplotype", "genotype"))


@query(
    "g20_x30_phase_groups",
    f"""{C}, k AS (SELECT country, gene, diplotype AS genotype, phenotype, raw_alleles, COUNT(DISTINCT participant_id) AS n FROM c GROUP BY ALL), s AS (SELECT country, gene, COUNT(DISTINCT participant_id) AS sc FROM c WHERE diplotype<>'' GROUP BY ALL),
    j AS (SELECT k.*, COALESCE(sc,0) AS sample_count FROM k LEFT JOIN s USING (country, gene))
    SELECT country, gene, genotype, phenotype, raw_alleles, n AS count, sample_count, COALESCE({FREQ},0) AS frequency, substr(sha256(concat_ws(chr(31), country, gene, genotype, phenotype, raw_alleles)),1,12) AS group_id FROM j""",
)
def phase_groups(spark, sf_dir):
    return reports.phase_groups(calls(spark, sf_dir).withColumnRenamed("diplotype", "genotype"))


@query(
    "g23_burden",
    f"""{REFERENCE_CTE}, b AS (SELECT country, gene, COUNT(DISTINCT participant_id) AS participants, COUNT(*) FILTER (NOT {REFERENCE}) AS nonref FROM t WHERE gene <> '' GROUP BY ALL)
    SELECT country, gene, participants, nonref, ROUND(CAST(nonref AS DOUBLE)/participants,6) AS rate FROM b""",
)
def burden(spark, sf_dir):
    return reports.burden(calls(spark, sf_dir))


@query("j18_not_reported", f"{C} SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS participant_id, 'no_report' AS status FROM customer WHERE concat('c', CAST(c_custkey AS VARCHAR)) NOT IN (SELECT participant_id FROM c WHERE gene='GENE1')")
def not_reported(spark, sf_dir):
    roster = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("participant_id"))
    return reports.not_reported(roster, calls(spark, sf_dir).where("gene = 'GENE1'"))


@query("x26_reference_like", f"{REFERENCE_CTE} SELECT diplotype, {REFERENCE} AS reference_like, trim(regexp_replace(diplotype, '\\s*\\([^()]*\\)\\s*$', '')) AS stripped, COUNT(*) AS rows FROM t GROUP BY ALL")
def reference_like(spark, sf_dir):
    rows = calls(spark, sf_dir).groupBy("diplotype").agg(F.count("*").alias("rows"))
    return rows.select("diplotype", L.reference_like(F.col("diplotype")).alias("reference_like"), L.strip_score(F.col("diplotype")).alias("stripped"), "rows")


HLA = """SELECT concat('i', CAST(c_custkey AS VARCHAR(10))) AS individual_id, concat('f', CAST(c_custkey % 50 AS VARCHAR(10))) AS family_id, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'DRB1' END AS gene,
CASE c_custkey % 4 WHEN 0 THEN '0201,0301' WHEN 1 THEN '10101,0301' WHEN 2 THEN '0,0201' ELSE '1501,' END AS specific, CAST(c_custkey % 64 AS DOUBLE)/64 AS posterior, c_nationkey FROM customer"""
HLA_ROWS = f"""WITH h AS ({HLA}), r AS (SELECT individual_id AS participant_id, CASE WHEN c_nationkey%3=0 THEN concat('land', CAST(c_nationkey AS VARCHAR)) WHEN family_id IN ('f1','f2','f3') THEN 'island' ELSE 'Unknown' END AS country, concat('HLA-', gene) AS hla_gene,
CASE specific WHEN '0201,0301' THEN concat('HLA-',gene,'*02:01/HLA-',gene,'*03:01') WHEN '10101,0301' THEN concat('HLA-',gene,'*101:01/HLA-',gene,'*03:01') WHEN '0,0201' THEN concat('0/HLA-',gene,'*02:01') ELSE concat('HLA-',gene,'*15:01/0') END AS genotype, posterior FROM h)"""


def hla(spark, sf_dir):
    h = sql(spark, sf_dir, HLA, "customer")
    own = h.where("c_nationkey % 3 = 0").select(F.col("individual_id").alias("participant_id"), F.concat(F.lit("land"), F.col("c_nationkey").cast("string")).alias("country"))
    family = spark.createDataFrame([("f1", "island"), ("f2", "island"), ("f3", "island")], "participant_id string, country string")
    return reports.hla_rows(h, own.unionByName(family))


@query("x24_j22_hla_rows", f"{HLA_ROWS} SELECT * FROM r")
def hla_rows(spark, sf_dir):
    return hla(spark, sf_dir)


@query(
    "g21_hla_counts",
    f"""{HLA_ROWS}, k AS (SELECT country, hla_gene, genotype, COUNT(*) AS n FROM r GROUP BY ALL), s AS (SELECT country, hla_gene, COUNT(DISTINCT participant_id) AS sample_count FROM r GROUP BY ALL)
    SELECT country, hla_gene, genotype, n AS count, sample_count, {FREQ} AS frequency FROM k JOIN s USING (country, hla_gene)""",
)
def hla_counts(spark, sf_dir):
    return reports.hla_counts(hla(spark, sf_dir))


@query("g21_hla_posteriors", f"{HLA_ROWS} SELECT country, hla_gene, COUNT(DISTINCT participant_id) AS sample_count, ROUND(AVG(posterior),6) AS mean_posterior FROM r GROUP BY ALL")
def hla_posteriors(spark, sf_dir):
    return reports.hla_posteriors(hla(spark, sf_dir)).withColumn("mean_posterior", F.round("mean_posterior", 6))


EVENTS = "SELECT concat('u', CAST(user_id AS VARCHAR(12))) AS participant_id, concat('land', CAST(user_id % 7 AS VARCHAR(4))) AS country, event_type, props, CAST(CAST(FLOOR(value) AS BIGINT) % 3 AS INT) AS v FROM events"


@query(
    "g22_assay_frequencies",
    f"""WITH e AS ({EVENTS}), k AS (SELECT country, event_type, v, COUNT(DISTINCT participant_id) AS n FROM e GROUP BY ALL), s AS (SELECT country, event_type, COUNT(DISTINCT participant_id) AS sample_count FROM e GROUP BY ALL)
    SELECT country, event_type, v, n AS count, sample_count, {FREQ} AS frequency FROM k JOIN s USING (country, event_type)""",
)
def assay_frequencies(spark, sf_dir):
    return reports.distinct_frequencies(sql(spark, sf_dir, EVENTS, "events"), ["country", "event_type"], ["v"])


@query("x27_s34_primary_values", "SELECT event_type, 'k' AS result_key, json_extract_string(props, '$.k') AS result_value, COUNT(*) AS rows FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def primary_values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("props").alias("json"))
    return reports.primary_values(e, ["absent", "k"]).groupBy("event_type", "result_key", "result_value").agg(F.count("*").alias("rows"))


#: Result rows as three assays write them, and which keys are emitted, in JSON.
ANALYSIS = """SELECT c_custkey AS id, concat('a', CAST(FLOOR(c_custkey / 12) AS BIGINT) % 3) AS assay_id, CASE WHEN c_custkey % 12 = 4 THEN '[{"key": "status"}, {"key": "result"}]' ELSE '[]' END AS emits,
CASE c_custkey % 12 WHEN 0 THEN concat('{"system": "ABO", "phenotype": "p", "blood_type": "v', c_nationkey, '"}') WHEN 1 THEN concat('{"system": " ABO ", "phenotype": "v', c_nationkey, '", "blood_type": " ", "abo_genotype": "A/O"}')
  WHEN 2 THEN concat('{"notes": "n", "dose": "d", "risk_status": "v', c_nationkey, '"}') WHEN 3 THEN concat('{"confidence": "high", "nested": {"x": 1}, "dose": "v', c_nationkey, '"}')
  WHEN 4 THEN concat('{"status": "", "result": "v', c_nationkey, '", "dose": "d"}') WHEN 5 THEN '{"notes": "n", "confidence": "c"}'
  WHEN 6 THEN '{"condition": "c1", "drug": "d1", "genotype": "Missing", "hla_allele": "B*57"}' WHEN 7 THEN concat('{"drug": "d1", "genotype": "v', c_nationkey, '"}')
  WHEN 8 THEN concat('{"hla_proxy_status": "s", "hla_proxy_key": "k", "result": "v', c_nationkey, '"}') WHEN 9 THEN concat('{"hla_proxy_key": "v', c_nationkey, '", "system": "S", "phenotype": "p"}')
  WHEN 10 THEN concat('{"system": "Rh", "result": "v', c_nationkey, '"}') ELSE '{"system": "ABO/RhD summary", "result": "r"}' END AS js FROM customer"""
KINDS = [("a0", "pgx1"), ("a1", "blood_type"), ("a2", "apol1")]
NOISY = "('participant_id','system','confidence','genotypes','limitations','interpretation','notes')"
ANALYSIS_FIELDS = ", ".join(f"trim(coalesce(json_extract_string(js, '$.{k}'), '')) AS {k}" for k in ("system", "blood_type", "phenotype", "abo_genotype", "hla_proxy_key", "condition", "drug", "genotype", "hla_allele", "hla_proxy_status"))


def analysis_sql(kind: str) -> str:
    """The rows of one assay, ``r (system, result_key, result_value)``, each kind by its own chain of conditions."""
    system = "SELECT system, 'blood_type', blood_type FROM f WHERE {0} system<>'' AND blood_type<>'' UNION ALL SELECT system, 'phenotype', phenotype FROM f WHERE {0} system<>'' AND blood_type='' AND phenotype<>''"
    chains = {
        "apol1": (system.format(""), "system<>'' AND (blood_type<>'' OR phenotype<>'')"),
        "blood_type": (system.format("") + " UNION ALL SELECT system, 'abo_genotype', CASE WHEN abo_genotype='' THEN 'Unresolved' ELSE abo_genotype END FROM f WHERE system IN ('ABO','ABO/RhD summary')", "system<>'' AND (blood_type<>'' OR phenotype<>'' OR system IN ('ABO','ABO/RhD summary'))"),
        "pgx1": (
            "SELECT CASE WHEN condition<>'' THEN condition ELSE drug END, CASE WHEN hla_allele<>'' THEN concat(hla_allele,'_genotype') ELSE 'genotype' END, CASE WHEN genotype<>'' AND lower(genotype)<>'missing' THEN genotype ELSE 'Unresolved' END FROM f WHERE condition<>'' OR drug<>''"
            " UNION ALL SELECT '', 'hla_proxy_key', hla_proxy_key FROM f WHERE condition='' AND drug='' AND hla_allele='' AND hla_proxy_status='' AND hla_proxy_key<>'' UNION ALL "
            + system.format("condition='' AND drug='' AND hla_allele='' AND hla_proxy_status='' AND hla_proxy_key='' AND"),
            "condition<>'' OR drug<>'' OR hla_allele<>'' OR hla_proxy_status<>'' OR hla_proxy_key<>'' OR (system<>'' AND (blood_type<>'' OR phenotype<>''))",
        ),
    }
    chosen, known = chains[kind]
    return f"""WITH f AS (SELECT *, {ANALYSIS_FIELDS} FROM ({ANALYSIS}) c WHERE assay_id='{dict(map(reversed, KINDS))[kind]}'),
    k AS (SELECT *, list_filter(CASE WHEN emits<>'[]' THEN ['status','result'] ELSE list_filter(json_keys(js), lambda k: json_type(js, concat('$.',k)) NOT IN ('OBJECT','ARRAY')) END, lambda k: k NOT IN {NOISY}) AS keys FROM f WHERE NOT ({known})),
    s AS (SELECT *, list_filter(keys, lambda k: suffix(k,'_status') OR k IN ('status','result','phenotype','blood_type')) AS st FROM k),
    g AS (SELECT js, list_filter(CASE WHEN len(st)>0 THEN st ELSE keys END, lambda k: trim(coalesce(json_extract_string(js, concat('$.',k)),''))<>'')[1] AS key FROM s),
    r(system, result_key, result_value) AS ({chosen} UNION ALL SELECT '', key, trim(json_extract_string(js, concat('$.',key))) FROM g WHERE key IS NOT NULL)
    SELECT system, result_key, result_value, COUNT(*) AS rows FROM r GROUP BY ALL"""


def analysis_rows(spark, sf_dir):
    c = sql(spark, sf_dir, ANALYSIS, "customer")
    lines = c.select(F.concat(F.lit('{"assay_id": "'), "assay_id", F.lit('", "analysis_id": "x", "emits": '), "emits", F.lit(', "rows": ['), "js", F.lit("]}")).alias("value"))
    path = scratch(spark)
    lines.unionByName(spark.createDataFrame([("not json",)], "value string")).write.text(path)
    kinds = spark.createDataFrame(KINDS, "assay_id string, kind string")
    return reports.analysis_values(tables.analysis_jsonl(spark, path), kinds).join(kinds, "assay_id")


def analysis_of(kind):
    def found(spark, sf_dir):
        return analysis_rows(spark, sf_dir).where(F.col("kind") == kind).groupBy("system", "result_key", "result_value").agg(F.count("*").alias("rows"))

    return found


for _, _kind in KINDS:
    query(f"s34_x27_{_kind}_values", analysis_sql(_kind))(analysis_of(_kind))


@query("s34_x27_analysis_values", " UNION ALL ".join(f"SELECT '{k}' AS kind, x.* FROM ({analysis_sql(k)}) x" for _, k in KINDS))
def all_analysis_values(spark, sf_dir):
    return analysis_rows(spark, sf_dir).groupBy("kind", "system", "result_key", "result_value").agg(F.count("*").alias("rows"))


#: A sample's sites as a VCF has them: each order is a sample, each of its lines a site.
SITES = """SELECT l_orderkey AS sample_id, CASE l_partkey % 8 WHEN 0 THEN 'chr10' WHEN 1 THEN '2' WHEN 2 THEN 'X' WHEN 3 THEN 'chrM' WHEN 4 THEN 'chr2' WHEN 5 THEN 'GL000' WHEN 6 THEN 'chrY' ELSE '1' END AS chrom, l_suppkey AS pos, 'A' AS ref,
CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'G,T' WHEN 2 THEN ' C , T' WHEN 3 THEN 'GT,<DEL>,C' ELSE '' END AS alt,
CASE WHEN l_orderkey % 7 = 0 THEN 'DP:GT' WHEN l_orderkey % 7 = 1 THEN 'DP' ELSE 'GT:DP' END AS ks,
CASE (l_suppkey + l_linenumber) % 11 WHEN 0 THEN '0/1' WHEN 1 THEN './.' WHEN 2 THEN '1|2' WHEN 3 THEN '0/0' WHEN 4 THEN '2/2' WHEN 5 THEN '.|1' WHEN 6 THEN '1' WHEN 7 THEN '0|0' WHEN 8 THEN '' WHEN 9 THEN '3/0' ELSE '.' END AS g FROM lineitem"""


@query(
    "x29_raw_alleles",
    f"""WITH s AS ({SITES}), a AS (SELECT *, string_split(g, CASE WHEN contains(g,'|') THEN '|' ELSE '/' END) AS al, CASE WHEN contains(g,'|') THEN '|' ELSE '/' END AS sep,
      list_filter(list_transform(string_split(alt,','), lambda x: trim(x)), lambda x: x<>'') AS alts, regexp_replace(chrom,'^chr','','i') AS bare FROM s WHERE g NOT IN ('','0/0','0|0')),
    t AS (SELECT *, unnest(range(1,len(alts)+1)) AS k FROM a),
    h AS (SELECT *, list_transform(al, lambda x: CASE WHEN x='.' THEN '.' WHEN x=CAST(k AS VARCHAR) THEN '1' ELSE '0' END) AS seen FROM t WHERE len(list_filter(al, lambda x: x<>'.'))=0 OR list_contains(list_transform(al, lambda x: TRY_CAST(x AS INT)), k)),
    k AS (SELECT *, concat(chrom,':',pos,':',ref,'>',alts[k],'=',CASE WHEN len(list_filter(seen, lambda x: x<>'.'))=0 THEN './.' WHEN seen=['1','1'] THEN '1/1' ELSE replace(array_to_string(seen, '/'), '/', sep) END) AS token,
      CASE WHEN TRY_CAST(bare AS INT) IS NOT NULL THEN CAST(bare AS INT) WHEN bare='X' THEN 23 WHEN bare='Y' THEN 24 WHEN bare='M' THEN 25 END AS rank FROM h)
    SELECT s.sample_id, coalesce(array_to_string(list(token ORDER BY rank IS NULL, coalesce(rank,0), bare, k.pos, k.ref, alts[k], token) FILTER (token IS NOT NULL), ';'),'') AS raw_alleles FROM (SELECT DISTINCT sample_id FROM s) s LEFT JOIN k ON s.sample_id=k.sample_id GROUP BY s.sample_id""",
)
def raw_alleles(spark, sf_dir):
    s = sql(spark, sf_dir, SITES, "lineitem")
    values = F.when(F.col("ks") == "DP:GT", F.concat(F.lit("7:"), "g")).otherwise(F.concat("g", F.lit(":7")))
    site = F.struct("chrom", "pos", "ref", "alt", L.sample_genotype(F.col("ks"), values).alias("gt"))
    rows = s.select("sample_id", site.alias("site")).repartition("sample_id")  # sites are made in compiled code, and arrays once
    return rows.groupBy("sample_id").agg(F.collect_list("site").alias("sites")).select("sample_id", L.raw_allele_tokens(F.col("sites")).alias("raw_alleles"))


@query(
    "s31_x25_gene_calls",
    """SELECT concat('u', CAST(n_nationkey AS VARCHAR)) AS participant_id, 'G1' AS gene, '*1/*2' AS label, concat('p', CAST(n_nationkey % 3 AS VARCHAR)) AS phenotype, '*1/*2; *1/*3' AS possible FROM nation""",
)
def gene_calls(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    json = F.format_string('{"genes": {"G1": {"sourceDiplotypes": [{"label": "*1/*2", "matchScore": 0.5, "phenotypes": ["p%d"]}, {"label": "*1/*3 (0.4)"}, {"label": "*1/*2 (0.1)"}]}}}', F.col("n_nationkey") % 3)
    return reports.gene_calls(n.select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("participant_id"), json.alias("json")))


@query(
    "j23_full_files",
    f"WITH g AS ({GENOTYPES_SQL}), t AS (SELECT DISTINCT chrom, pos, rsid FROM g), o AS (SELECT chrom, pos, gt FROM g WHERE sample_id=3) SELECT t.chrom, t.pos, t.rsid, COALESCE(o.gt,'--') AS gt FROM t LEFT JOIN o ON t.chrom=o.chrom AND t.pos=o.pos",
)
def full_files(spark, sf_dir):
    g = genotypes(spark, sf_dir)
    return synth.full_files(g.select("chrom", "pos", "rsid").distinct().withColumn("gt", F.lit("--")), g.where("sample_id = 3"))


@query("f25_founders", "SELECT CAST(c_custkey AS BIGINT) AS sample_id FROM customer WHERE c_custkey%3=0 AND c_custkey%2=0")
def founders(spark, sf_dir):
    from ..operators.filters import founders as keep

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parent = lambda m: F.when(F.col("c_custkey") % m == 0, "0").otherwise("x")
    return keep(c.select(F.col("c_custkey").cast("long").alias("sample_id"), parent(3).alias("father_id"), parent(2).alias("mother_id"))).select("sample_id")


@query(
    "y06_frozen_reference",
)
def frozen_reference(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return synth.frozen_reference(c.select(F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("superpopulation")), 20)


@query("y01_cohort_plan", "SELECT concat('P', lpad(CAST(i+1 AS VARCHAR),6,'0')) AS participant_id, CASE WHEN (i*37)%100<55 THEN 'M' ELSE 'F' END AS sex, ['a','b','c'][i%3+1] AS island, CASE WHEN i%2=0 THEN 'ddna' ELSE 'illumina' END AS format FROM range(300) t(i)")
def cohort_plan(spark, sf_dir):
    return synth.cohort_plan(spark, 300, ["a", "b", "c"])


@query(
    "y02_overlay",
    f"""WITH g AS ({GENOTYPES_SQL}), b AS (SELECT DISTINCT rsid, chrom, pos, ref, alt FROM g WHERE pos<=20000), p AS (SELECT concat('P', lpad(CAST(i+1 AS VARCHAR),6,'0')) AS participant_id, ['a','b','c'][i%3+1] AS island FROM range(60) t(i))
    SELECT participant_id, rsid, chrom, pos, CASE WHEN island='b' THEN concat(alt,alt) ELSE concat(ref,ref) END AS gt FROM p CROSS JOIN b""",
)
def overlay(spark, sf_dir):
    block = genotypes(spark, sf_dir).where("pos <= 20000").select("rsid", "chrom", "pos", "ref", "alt").distinct()
    return synth.overlay(synth.cohort_plan(spark, 60, ["a", "b", "c"]), block, "b")


@query("y03_blocks")
def blocks(spark, sf_dir):
    return synth.blocks(genotypes(spark, sf_dir).select("rsid", "chrom", "pos").distinct(), {"projection": 40, "structure": 30, "sex": 10})


@query("y05_mixed_draw")
def mixed_draw(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sample_id"), ((F.col("c_custkey") % 11) / 10).alias("f"), (F.col("c_custkey") % 2 == 0).alias("haploid"))
    sites = genotypes(spark, sf_dir).select("rsid", "pos").distinct().select("rsid", ((F.col("pos") % 7) / 10 + 0.1).alias("p_a"), ((F.col("pos") % 5) / 10 + 0.2).alias("p_b"))
    return synth.mixed_draw(people, sites)


@query("j12_scores_and_labels", "SELECT CAST(c_custkey AS BIGINT) AS sample_id, n_name AS population FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey<20) n ON c_nationkey=n_nationkey")
def scores_and_labels(spark, sf_dir):
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return c.join(n.where("n_nationkey < 20"), c.c_nationkey == n.n_nationkey, "left").select(c.c_custkey.cast("long").alias("sample_id"), n.n_name.alias("population"))


@query("w09_roster_cap", "WITH r AS (SELECT c_mktsegment, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) SELECT c_mktsegment, c_custkey FROM r WHERE n<=5")
def roster_cap(spark, sf_dir):
    return popgen.capped(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey"), "c_mktsegment", ["c_custkey"], 5)
