"""Labels and comparisons of ancestry proportions, nearest populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admix, ancestry, linalg
from .cohort import CTE, dosages
from .fixture import PROPORTIONS_SQL, proportions, sql
from .registry import query

Q = f"WITH p AS ({PROPORTIONS_SQL})"
LABELS = f"""{Q}, me AS (SELECT region, component, superpopulation, ROUND(AVG(q),9) AS m FROM p WHERE superpopulation IS NOT NULL GROUP BY ALL),
be AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region, component ORDER BY m DESC, superpopulation) AS n FROM me),
la AS (SELECT region, component, superpopulation, ROW_NUMBER() OVER (PARTITION BY region, superpopulation ORDER BY component) AS k FROM be WHERE n=1),
lb AS (SELECT region, component, CASE WHEN k=1 THEN superpopulation ELSE concat_ws('_', superpopulation, CAST(k AS VARCHAR)) END AS label FROM la),
fr AS (SELECT p.*, label, CASE WHEN superpopulation IS NULL THEN 'study' ELSE 'reference' END AS grp FROM p JOIN lb USING (region, component))"""


def frame(spark, sf_dir, region):
    p = proportions(spark, sf_dir).where(F.col("region") == region)
    q = p.select("sample_id", "component", "q")
    labels = p.where("superpopulation is not null").select("sample_id", "superpopulation").distinct()
    return ancestry.framed(q, labels, p.select("sample_id", "sex").distinct())


def labelled(spark, sf_dir, region):
    f = frame(spark, sf_dir, region)
    return f.join(F.broadcast(ancestry.component_labels(f)), "component")


@query("g24_w04_component_labels", f"{LABELS} SELECT component, label FROM lb WHERE region='auto'")
def component_labels(spark, sf_dir):
    return ancestry.component_labels(frame(spark, sf_dir, "auto"))


@query("j13_framed", f"{Q} SELECT CASE WHEN superpopulation IS NULL THEN 'study' ELSE 'reference' END AS grp, superpopulation, sex, COUNT(*) AS rows, ROUND(SUM(q),6) AS q FROM p WHERE region='auto' GROUP BY ALL")
def framed(spark, sf_dir):
    return frame(spark, sf_dir, "auto").groupBy("grp", "superpopulation", "sex").agg(F.count("*").alias("rows"), F.round(F.sum("q"), 6).alias("q"))


@query(
    "g25_anchored_labels",
    f"""{Q}, me AS (SELECT superpopulation AS label, component, AVG(q) AS m, COUNT(DISTINCT sample_id) AS anchors FROM p WHERE region='auto' AND superpopulation IS NOT NULL GROUP BY ALL HAVING COUNT(DISTINCT sample_id)>=3),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY m DESC, component) AS n FROM me) SELECT label, CAST(component AS INTEGER) AS component, ROUND(m,6) AS mean_q, anchors FROM r WHERE n=1""",
)
def anchored_labels(spark, sf_dir):
    p = proportions(spark, sf_dir).where("region = 'auto'")
    anchors = p.where("superpopulation is not null").select("sample_id", F.col("superpopulation").alias("label")).distinct()
    return ancestry.anchored_labels(p.select("sample_id", "component", "q"), anchors).withColumn("mean_q", F.round("mean_q", 6))


X = f"""{LABELS}, a AS (SELECT label, AVG(q) AS auto FROM fr WHERE region='auto' AND grp='study' GROUP BY label),
x AS (SELECT label, AVG(q) AS x, AVG(q) FILTER (sex='2') AS f, AVG(q) FILTER (sex='1') AS m FROM fr WHERE region='x' AND grp='study' GROUP BY label)"""


@query("g27_x_against_autosomes", f"{X} SELECT label, ROUND(auto,4) AS mean_auto, ROUND(x,4) AS mean_x, ROUND(x-auto,4) AS delta, ROUND(f,4) AS mean_x_female, ROUND(m,4) AS mean_x_male FROM a JOIN x USING (label)")
def x_against_autosomes(spark, sf_dir):
    return ancestry.x_against_autosomes(labelled(spark, sf_dir, "auto"), labelled(spark, sf_dir, "x"))


@query("t07_focal", f"{X} SELECT label, ROUND(x-auto,4) AS delta FROM a JOIN x USING (label) ORDER BY ABS(ROUND(x-auto,4)) DESC, label LIMIT 1")
def focal(spark, sf_dir):
    return ancestry.focal(ancestry.x_against_autosomes(labelled(spark, sf_dir, "auto"), labelled(spark, sf_dir, "x"))).select("label", "delta")


@query("j14_per_sample", f"{LABELS} SELECT a.sample_id, a.label, a.q AS q_auto, b.q AS q_x, ROUND(b.q-a.q,6) AS delta FROM fr a JOIN fr b ON a.sample_id=b.sample_id AND a.label=b.label WHERE a.region='auto' AND b.region='x'")
def per_sample(spark, sf_dir):
    return ancestry.per_sample(labelled(spark, sf_dir, "auto"), labelled(spark, sf_dir, "x"))


RUNS = "SELECT CAST(3 + c_custkey % 8 AS INT) AS k, CAST(c_custkey AS BIGINT) AS rep, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 4000.0 + 0.1 AS cv, CAST(c_custkey % 60 AS BIGINT) AS seconds FROM customer"


@query(
    "g26_t06_cv_summary",
    f"""WITH r AS ({RUNS}), s AS (SELECT k, AVG(cv) AS m, STDDEV_POP(cv) AS sd, MIN(cv) AS least, CAST(SUM(seconds) AS BIGINT) AS seconds FROM r GROUP BY k)
    SELECT k, ROUND(m,6) AS mean_cv, ROUND(sd,6) AS sd_cv, (SELECT MIN(rep) FROM r WHERE r.k=s.k AND cv=least) AS best_rep, seconds, k=(SELECT k FROM s ORDER BY m, k LIMIT 1) AS best_k FROM s""",
)
def cv_summary(spark, sf_dir):
    rows = ancestry.cv_summary(sql(spark, sf_dir, RUNS, "customer"))
    return rows.withColumns({"mean_cv": F.round("mean_cv", 6), "sd_cv": F.round("sd_cv", 6)})


@query(
    "s37_cv_errors",
    "SELECT concat('log', CAST(n_nationkey AS VARCHAR)) AS file, CAST(3 + n_nationkey % 7 AS INTEGER) AS k, CAST(n_nationkey + 1 AS DOUBLE) / 64 AS cv FROM nation",
)
def cv_errors(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = F.array(
        F.lit("start"),
        F.concat(F.lit("CV error (K=3): "), F.lit("0.9")),
        F.concat(F.lit("CV error (K="), (3 + F.col("n_nationkey") % 7).cast("string"), F.lit("): "), ((F.col("n_nationkey") + 1) / 64).cast("string")),
        F.lit("end"),
    )
    rows = n.select(F.concat(F.lit("log"), F.col("n_nationkey").cast("string")).alias("file"), F.posexplode(lines).alias("line_number", "line"))
    return ancestry.cv_errors(rows)


POINTS = "SELECT sample_id, pop, CASE WHEN sample_id % 8 < 4 THEN 'A' ELSE 'B' END AS region, CAST(SUM(dosage) FILTER (ref = 'A') AS DOUBLE) / 8 AS x, CAST(SUM(dosage) FILTER (alt = 'T') AS DOUBLE) / 8 AS y FROM d GROUP BY sample_id, pop"
CENTRES = f"{CTE}, t AS ({POINTS}), c AS (SELECT region, pop AS population, COUNT(*) AS n_ref, AVG(x) AS cx, AVG(y) AS cy FROM t WHERE pop <> 'west' GROUP BY ALL)"


def points(spark, sf_dir):
    d = dosages(spark, sf_dir)
    total = lambda side: F.sum(F.when(side, F.col("dosage"))).cast("double") / 8
    return d.groupBy("sample_id", "pop").agg(F.array(total(F.col("ref") == "A"), total(F.col("alt") == "T")).alias("pcs")).withColumn("region", F.when(F.col("sample_id") % 8 < 4, "A").otherwise("B"))


def centres(spark, sf_dir):
    t = points(spark, sf_dir).where("pop <> 'west'")
    return linalg.centroids(t.select("sample_id", "pcs"), t.select("sample_id", "region", F.col("pop").alias("population")), 2)


@query("g28_centroids", f"{CENTRES} SELECT region, population, n_ref, ROUND(cx,6) AS x, ROUND(cy,6) AS y FROM c")
def centroids(spark, sf_dir):
    c = centres(spark, sf_dir)
    return c.select("region", "population", "n_ref", F.round(c.centroid[0], 6).alias("x"), F.round(c.centroid[1], 6).alias("y"))


@query(
    "j17_w03_closest",
    f"""{CENTRES}, e AS (SELECT sample_id, region, population, n_ref, SQRT((x-cx)*(x-cx)+(y-cy)*(y-cy)) AS dist FROM (SELECT sample_id, x, y FROM t WHERE pop = 'west') CROSS JOIN c),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY dist, region, population) AS rank, MIN(dist) OVER (PARTITION BY sample_id) AS best FROM e)
    SELECT sample_id, CAST(rank AS INTEGER) AS rank, region, population, concat('[', region, '] ', population) AS label, n_ref, ROUND(dist,6) AS distance, dist<=best*1.15 AS close FROM r WHERE rank<=5""",
)
def closest(spark, sf_dir):
    study = points(spark, sf_dir).where("pop = 'west'").select("sample_id", "pcs")
    return linalg.closest(study, centres(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("w07_s38_explained", "SELECT CAST(l_linenumber AS INTEGER) AS pc, ROUND(SUM(l_quantity),2) AS value, ROUND(100*SUM(l_quantity)/(SELECT SUM(l_quantity) FROM lineitem),6) AS percent FROM lineitem GROUP BY l_linenumber")
def explained(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").cast("int").alias("pc")).agg(F.sum("l_quantity").alias("value"))
    return linalg.explained(rows).select("pc", F.round("value", 2).alias("value"), F.round("percent", 6).alias("percent"))


@query("m10_admixture_em")
def admixture_em(spark, sf_dir):
    return ancestry.admixture_em(dosages(spark, sf_dir), 3, 5)


@query("m10_admixture_sweep")
def admixture_sweep(spark, sf_dir):
    models = [admix.Model(k, 7 + k, fold) for k in (2, 3) for fold in (None, 0, 1)]
    runs = admix.fit(dosages(spark, sf_dir), models, 2, tolerance=1.0, most_rounds=90).runs
    return runs.select("model", "k", "fold", "rounds", F.round("likelihood", 3).alias("likelihood"), "converged", F.round("cv", 6).alias("cv"))
