"""Frequency tables, panels, loadings, scores and caller reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import labels as L


def population_files(spark: SparkSession, path: str) -> DataFrame:
    """``(pop, locus_key, rsid, allele_freq, allele_number)`` of allele_freq_<pop>.tsv files or folders in ``path``; no calls are nulls."""
    df = spark.read.csv(f"{path.rstrip('/')}/allele_freq_*.tsv", sep="\t", header=True, schema="locus_key string, rsid string, allele_freq double, allele_number long")
    called = F.col("allele_number") > 0
    pop = L.population(F.regexp_extract(F.col("_metadata.file_path"), r"/allele_freq_([^/]*)\.tsv(?:/[^/]*)?$", 1))
    return df.select(pop.alias("pop"), "locus_key", "rsid", F.when(called, F.col("allele_freq")).alias("allele_freq"), F.when(called, F.col("allele_number")).alias("allele_number"))


def populations(wanted: str, found: list[str]) -> list[str]:
    """Wanted populations, normalised and distinct in order, or else those found; an error lists what is missing."""
    import re

    clean = [re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", w.strip().lower())) for w in wanted.split(",")] if wanted.strip() else sorted(found)
    clean = list(dict.fromkeys(c for c in clean if c))
    if not clean or (missing := [c for c in clean if c not in found]):
        raise ValueError(f"no table for {missing if clean else 'any population'}; there are {sorted(found)}")
    return clean


def require_columns(df: DataFrame, columns: list[str], where: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{where} lacks {missing}")
    return df


def reference_slices(spark: SparkSession, path: str) -> DataFrame:
    """``(locus_key, af, af_afr, af_nfe, af_sas)`` of headerless site tables; a dot is no value.

    Of rows with one locus the first stays, in order of file and place: a split's rows are numbered as they are read, and
    splits of a file are in order of their start.
    """
    from ..operators.lookups import first_slices

    df = spark.read.csv(path, sep="\t", nullValue=".", schema="chrom string, pos long, ref string, alt string, af double, af_afr double, af_nfe double, af_sas double")
    key = G.locus_key(G.clean_chrom(F.col("chrom")), F.col("pos"), F.col("ref"), F.col("alt"))
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return first_slices(df.select(key.alias("locus_key"), "af", "af_afr", "af_nfe", "af_sas", *place))


def panel(df: DataFrame) -> DataFrame:
    """``(sample_id, population, region)`` with names by alias and regions' aliases resolved."""
    from .text import named

    names = {"sample_id": ["sample_id", "sample", "s", "iid"], "population": ["population", "pop"], "region": ["region", "superpopulation", "super_pop"]}
    return named(df, names, ["sample_id", "population", "region"]).withColumn("region", L.region(F.col("region")))


def panel_json(df: DataFrame, column: str = "hgdp_tgp_meta") -> DataFrame:
    """As ``panel`` from a JSON column; samples without a label go, and a blank population is the project's name."""
    value = lambda k: F.nullif(F.trim(F.get_json_object(column, f"$.{k}")), F.lit(""))
    rows = df.select("sample_id", F.coalesce(value("population"), value("project")).alias("population"), L.region(value("genetic_region")).alias("region"))
    return rows.where("population is not null and region is not null")


def panel_scores(df: DataFrame) -> DataFrame:
    """``(sample_id, region, population, pcs)`` from a panel's JSON columns; rows that lack any of them, or aren't JSON, go."""
    missing = lambda c: F.coalesce(F.col(c).isin("", "NA"), F.lit(True))
    rows = df.where(~missing("gnomad_population_inference") & ~missing("hgdp_tgp_meta"))
    pcs = F.from_json("gnomad_population_inference", "pca_scores array<double>")["pca_scores"]
    value = lambda k: F.nullif(F.get_json_object("hgdp_tgp_meta", f"$.{k}"), F.lit(""))
    rows = rows.select(F.col("s").alias("sample_id"), value("genetic_region").alias("region"), value("population").alias("population"), pcs.alias("pcs"))
    return rows.where("region is not null and population is not null and size(pcs) > 0")


def eigenval(spark: SparkSession, path: str) -> DataFrame:
    """``(pc, value)`` of a file with an eigenvalue a line."""
    lines = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("k", "v")).where("v <> ''")
    return rows.select((F.col("k") + 1).alias("pc"), F.col("v").try_cast("double").alias("value"))


def components(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``(name, component, value)`` of a white-space matrix without names: proportions by sample, or frequencies by variant."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s*\n\s*")).alias("n", "line"))
    known = F.broadcast(spark.createDataFrame([(k, x) for k, x in enumerate(names)], "n int, name string"))
    if lines.where(F.col("n") >= len(names)).where("line <> ''").head(1):
        raise ValueError(f"{path} has more than {len(names)} rows")
    rows = lines.join(known, "n").select("name", F.posexplode(F.split("line", r"\s+")).alias("component", "v"))
    return rows.select("name", "component", F.col("v").cast("double").alias("value"))


def score_arrays(df: DataFrame, column: str = "scores") -> DataFrame:
    """``(sample_id, pcs)`` from array literals or JSON arrays in text."""
    return df.select("sample_id", F.from_json(column, "array<double>").alias("pcs")).where("pcs is not null")


def eigenvec(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, pcs)`` of a white-space table; the family id in front and a header are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p")).where(~F.get("p", F.lit(0)).rlike("^#?FID$|^#IID$"))
    return rows.select(F.get("p", F.lit(1)).alias("sample_id"), F.transform(F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0))), lambda x: x.try_cast("double")).alias("pcs"))


def loadings(df: DataFrame) -> DataFrame:
    """``(chrom, pos, ref, alt, loadings, pca_af)``, the first row in file order (``nth``) of each locus."""
    names = ("ref", "alt", "loadings", "pca_af")
    first = df.groupBy("chrom", "pos").agg(F.min_by(F.struct(*names), "nth").alias("x"))
    return first.select("chrom", "pos", *(f"x.{n}" for n in names))


def keyed_af(df: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequencies of a file's rows ``(line_number, locus_key, allele_freq, allele_number)``, given to ``variants (chrom, pos, ref, alt)``.

    A key is four parts with colons or, where it has none, dashes; chromosomes lose a leading chr, M is MT, alleles are put
    in capitals. A variant takes both values from its first row in the file. The second table is one row that counts the
    file's rows: ``rows``, of which ``duplicates`` name a variant again, ``unmatched`` have no such key, no such variant
    or no whole allele number, and ``matched`` are the others. Values may be text.
    """
    parts = F.when(F.col("locus_key").contains(":"), F.split("locus_key", ":")).otherwise(F.split("locus_key", "-"))
    part = lambda k: F.when(F.size("parts") == 4, F.get("parts", F.lit(k)))
    key = ["chrom", "pos", "ref", "alt"]
    rows = df.select(parts.alias("parts"), "line_number", F.col("allele_number").try_cast("long").alias("allele_number"), F.col("allele_freq").try_cast("double").alias("allele_freq"))
    rows = rows.select(G.panel_chrom(part(0)).alias("chrom"), F.trim(part(1)).try_cast("long").alias("pos"), F.upper(part(2)).alias("ref"), F.upper(part(3)).alias("alt"), "line_number", "allele_number", "allele_freq")
    first = rows.groupBy(*key).agg(F.min_by(F.struct("allele_number", "allele_freq"), "line_number").alias("x"), F.count("*").alias("n"))
    of_file = first.join(variants.select(*key, F.lit(True).alias("known")).distinct(), key, "left")
    good = F.col("known") & F.col("x.allele_number").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    matched, again = F.when(good, 1).otherwise(0), F.when(F.col("known"), F.col("n") - 1).otherwise(0)
    counts = of_file.agg(total("n").alias("rows"), total(matched).alias("matched"), total(F.col("n") - matched - again).alias("unmatched"), total(again).alias("duplicates"))
    out = variants.join(first, key, "left").withColumns({"allele_freq": F.when(F.col("x.allele_number").isNotNull(), F.col("x.allele_freq")), "allele_number": F.coalesce("x.allele_number", F.lit(0))})
    return out.drop("x", "n"), counts


def pgx_report(lines: DataFrame) -> DataFrame:
    """``(participant_id, gene, diplotype, phenotype)`` of reports with a title line, then a header by name."""
    rows = lines.where(F.trim("line") != "").withColumn("p", F.split("line", "\t"))
    head = rows.where(F.get("p", F.lit(0)) == "Gene").groupBy("file").agg(F.min_by(F.struct("line_number", "p"), "line_number").alias("h"))
    rows = rows.join(head, "file").where(F.col("line_number") > F.col("h.line_number"))

    def value(*names: str):
        at = F.greatest(*(F.array_position("h.p", n) for n in names), F.lit(0)).cast("int")
        return F.when(at > 0, F.trim(F.get("p", at - 1)))

    return rows.select("participant_id", value("Gene").alias("gene"), value("Source Diplotype", "Genotype").alias("diplotype"), value("Phenotype", "phenotype").alias("phenotype"))


def caller_results(df: DataFrame) -> DataFrame:
    """``(gene, genotype, phenotype, status)`` with headers matched loosely; a blank genotype is made of two haplotypes."""
    have = {c.lower().replace(" ", "").replace("_", ""): c for c in df.columns}
    pick = lambda *names: next((F.trim(F.col(f"`{have[n]}`").cast("string")) for n in names if n in have), F.lit(None).cast("string"))
    pair = F.concat_ws("/", F.nullif(pick("haplotype1"), F.lit("")), F.nullif(pick("haplotype2"), F.lit("")))
    call = F.coalesce(F.nullif(pick("genotype", "diplotype"), F.lit("")), F.nullif(pair, F.lit("")), F.lit(""))
    return df.select(pick("gene").alias("gene"), call.alias("genotype"), F.coalesce(pick("phenotype"), F.lit("")).alias("phenotype"), F.coalesce(pick("status"), F.lit("")).alias("status"))


def analysis_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(assay_id, analysis_id, key, row)``: emitted keys and rows as JSON text; lines that aren't JSON are skipped."""
    schema = "assay_id string, analysis_id string, emits array<struct<key:string>>, rows array<map<string,string>>, _bad string"
    df = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").where("_bad is null")
    return df.select("assay_id", "analysis_id", F.transform("emits", lambda e: e["key"]).alias("keys"), F.explode("rows").alias("row"))


def intensity_long(df: DataFrame) -> DataFrame:
    """``(name, sample_id, baf, lrr)`` of a wide report with two columns a sample; blanks and NaN are 0."""
    samples = [c.removesuffix(".B Allele Freq") for c in df.columns if c.endswith(".B Allele Freq") and c.removesuffix(".B Allele Freq") + ".Log R Ratio" in df.columns]
    value = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(s).alias("sample_id"), value(f"{s}.B Allele Freq").alias("baf"), value(f"{s}.Log R Ratio").alias("lrr")) for s in samples))
    return df.select(F.col("Name").alias("name"), F.explode(each).alias("x")).select("name", "x.*")


def array_pairs(files: DataFrame, names: DataFrame) -> DataFrame:
    """``(chip, sample_id, red, green, problem)`` of intensity files paired by chip and colour."""
    chip, colour = F.regexp_extract("file", r"([^/]+)_(?:Red|Grn)\.idat(?:\.gz)?$", 1), F.regexp_extract("file", r"_(Red|Grn)\.idat", 1)
    pairs = files.select(chip.alias("chip"), colour.alias("colour"), "file").where("chip <> ''").groupBy("chip").pivot("colour", ["Red", "Grn"]).agg(F.min("file"))
    problem = F.concat_ws(";", F.when(F.col("Red").isNull(), "missing_red"), F.when(F.col("Grn").isNull(), "missing_green"))
    return pairs.join(names, "chip", "left").select("chip", F.coalesce("sample_id", "chip").alias("sample_id"), F.col("Red").alias("red"), F.col("Grn").alias("green"), problem.alias("problem"))
