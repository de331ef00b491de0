"""Frequencies by country from reports of drug-response, HLA and assay callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L


def frequency(count: Column, of: Column) -> Column:
    return F.when(of > 0, F.bround(count / F.nullif(of, F.lit(0)), 6)).otherwise(0.0)


def with_denominator(counts: DataFrame, rows: DataFrame, by: list[str], participant: str = "participant_id") -> DataFrame:
    """``counts`` with ``sample_count``, the distinct participants of ``rows`` by ``by``, and ``frequency``."""
    sizes = rows.groupBy(*by).agg(F.count_distinct(participant).alias("sample_count"))
    return counts.join(sizes, by, "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0))).withColumn("frequency", frequency(F.col("count"), F.col("sample_count")))


def call_frequencies(rows: DataFrame, call: list[str]) -> DataFrame:
    """Rows (not participants) by country, gene and ``call``, of the country and gene's participants."""
    return with_denominator(rows.groupBy("country", "gene", *call).count(), rows, ["country", "gene"])


def genotype_summary(rows: DataFrame) -> DataFrame:
    """As ``call_frequencies`` by genotype and phenotype, over rows with a genotype only."""
    return call_frequencies(rows.where(F.coalesce("genotype", F.lit("")) != ""), ["genotype", "phenotype"])


def phase_groups(rows: DataFrame) -> DataFrame:
    """Distinct participants by call and raw alleles, with a stable ``group_id``; the denominator has rows with a genotype only."""
    by = ["country", "gene", "genotype", "phenotype", "raw_alleles"]
    rows = rows.na.fill("", by)
    counts = rows.groupBy(*by).agg(F.count_distinct("participant_id").alias("count"))
    out = with_denominator(counts, rows.where("genotype <> ''"), ["country", "gene"])
    return out.withColumn("group_id", L.stable_group_id(*map(F.col, by)))


def hla_rows(alleles: DataFrame, countries: DataFrame) -> DataFrame:
    """``(participant_id, country, hla_gene, genotype, posterior)``; the country by individual, then family, else Unknown."""
    own = countries.select(F.col("participant_id").alias("individual_id"), F.col("country").alias("own"))
    family = countries.select(F.col("participant_id").alias("family_id"), F.col("country").alias("family"))
    pair = F.split("specific", ",")
    call = F.concat_ws("/", *(L.hla_allele(F.col("gene"), F.coalesce(F.get(pair, F.lit(k)), F.lit(""))) for k in range(2)))
    rows = alleles.join(own, "individual_id", "left").join(family, "family_id", "left")
    return rows.select(F.col("individual_id").alias("participant_id"), F.coalesce("own", "family", F.lit("Unknown")).alias("country"), F.concat(F.lit("HLA-"), "gene").alias("hla_gene"), call.alias("genotype"), "posterior")


def hla_counts(rows: DataFrame) -> DataFrame:
    return with_denominator(rows.groupBy("country", "hla_gene", "genotype").count(), rows, ["country", "hla_gene"])


def hla_posteriors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country", "hla_gene").agg(F.count_distinct("participant_id").alias("sample_count"), F.avg("posterior").alias("mean_posterior"))


def distinct_frequencies(rows: DataFrame, base: list[str], value: list[str]) -> DataFrame:
    """Distinct participants by ``base`` and ``value``, of those by ``base``."""
    return with_denominator(rows.groupBy(*base, *value).agg(F.count_distinct("participant_id").alias("count")), rows, base)


def burden(rows: DataFrame) -> DataFrame:
    """``(country, gene, participants, nonref, rate)``: rows whose diplotype isn't reference-like; a blank one isn't. Rows without a gene go."""
    rows = rows.where(F.trim("gene") != "")
    nonref = F.count_if(~L.reference_like(F.col("diplotype")))
    out = rows.groupBy("country", "gene").agg(F.count_distinct("participant_id").alias("participants"), nonref.alias("nonref"))
    return out.withColumn("rate", F.bround(F.col("nonref") / F.nullif(F.col("participants"), F.lit(0)), 6))


def not_reported(roster: DataFrame, rows: DataFrame) -> DataFrame:
    """Participants of the roster without a row, as failures."""
    return roster.join(rows, "participant_id", "left_anti").withColumn("status", F.lit("no_report"))


def primary_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(participant_id, result_key, result_value)`` from a JSON column: the first of ``keys`` that has a value."""
    found = [F.struct(F.lit(k).alias("result_key"), F.get_json_object("json", f"$.{k}").alias("result_value")) for k in keys]
    first = F.get(F.filter(F.array(*found), lambda s: s["result_value"].isNotNull() & (s["result_value"] != "")), F.lit(0))
    return rows.select("*", first.alias("x")).where("x is not null").select(*[c for c in rows.columns if c != "json"], "x.result_key", "x.result_value")


def haplotype_label(c: Column) -> Column:
    """Haplotype1 or Haplotype2 for whatever names them, else the name without blanks; Haplotype1 for none."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    digit = F.regexp_extract(raw, "([12])", 1)
    return F.when(raw == "", "Haplotype1").when(digit != "", F.concat(F.lit("Haplotype"), digit)).otherwise(F.replace(raw, F.lit(" "), F.lit("")))


def variant_name(direct: Column, rsid: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """``rsid@chrom-pos-ref-alt``, or what there is of a variant's own name and its rsid; parts are text, empty for none."""
    whole = (rsid != "") & (chrom != "") & (pos != "") & (ref != "") & (alt != "")
    both = (direct != "") & (rsid != "") & ~direct.contains("@") & (direct != rsid)
    named = F.when(both, F.concat(rsid, F.lit("@"), direct)).when(direct != "", direct).otherwise(rsid)
    return F.when(whole, F.concat(rsid, F.lit("@"), F.concat_ws("-", chrom, pos, ref, alt))).otherwise(named)


def signatures(rows: DataFrame) -> DataFrame:
    """``(sample, gene, top, full)`` of candidates ``(sample, gene, line_number, haplotype, rank, allele, variant, rsid, chrom, pos, ref, alt, genotype)``.

    A candidate is ``rank:name``, its name the allele, the variant, both joined by @, the genotype, or else the line's
    number. A haplotype lists its candidates by rank (one that is no number, or missing, counts as the line's number), and
    a gene its haplotypes by name; ``top`` has each haplotype's first candidate alone.
    """
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("rank", "allele", "variant", "rsid", "chrom", "pos", "ref", "alt", "genotype")}
    number = F.col("line_number").cast("string")
    rank = F.when(text["rank"] != "", text["rank"]).otherwise(number)
    allele, variant = text["allele"], variant_name(*(text[c] for c in ("variant", "rsid", "chrom", "pos", "ref", "alt")))
    same = (variant == allele) | variant.startswith(F.concat(allele, F.lit("@")))
    joined = F.when(same, variant).when(~allele.contains(variant), F.concat(allele, F.lit("@"), variant)).otherwise(allele)
    body = F.when((allele != "") & (variant != ""), joined).when(allele != "", allele).otherwise(variant)
    body = F.when(body != "", body).when(text["genotype"] != "", text["genotype"]).otherwise(F.concat(F.lit("row"), number))
    place = F.coalesce(rank.try_cast("double"), F.col("line_number").cast("double"))
    one = F.struct(place.alias("place"), rank.alias("rank"), F.col("line_number").alias("line"), F.concat(rank, F.lit(":"), body).alias("candidate"))
    found = rows.select("sample", "gene", haplotype_label(F.col("haplotype")).alias("haplotype"), one.alias("x"))
    held = found.groupBy("sample", "gene", "haplotype").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["candidate"]).alias("names"))
    parts = F.array_sort(F.collect_list(F.struct("haplotype", "names")))
    show = lambda of: F.array_join(F.transform("parts", lambda p: F.concat(p["haplotype"], F.lit("="), of(p["names"]))), "/")
    genes = held.groupBy("sample", "gene").agg(parts.alias("parts"))
    return genes.select("sample", "gene", show(lambda n: F.get(n, F.lit(0))).alias("top"), show(lambda n: F.array_join(n, "+")).alias("full"))


# Fixed keys of analysis rows: those that never hold the result, and those that do if they are there.
NOISY_KEYS = ("participant_id", "system", "confidence", "genotypes", "limitations", "interpretation", "notes")
STATUS_KEYS = ("status", "result", "phenotype", "blood_type")

RULE = "struct<priority:int,some:array<string>,all:array<string>,none:array<string>,systems:array<string>,scope:array<string>,key:string,prefix:string,value:string,missing:string,fallback:string>"


def rule(priority: int, key: str, value: str, *, some=(), all=(), none=(), systems=(), scope=(), prefix="", missing="", fallback="") -> tuple:  # noqa: A002
    """What a row gives if ``some`` (any of these columns, unless empty), ``all`` and ``none`` are filled, and its system is listed.

    The result's system is the first filled column of ``scope``, its key ``key`` after the value of column ``prefix``, its
    value that of column ``value`` or, where that is blank or ``missing``, ``fallback``. A rule without a value ends the row.
    """
    return (priority, [*some], [*all], [*none], [*systems], [*scope], key, prefix, value, missing, fallback)


BY_SYSTEM = [
    rule(2, "blood_type", "blood_type", all=["system", "blood_type"], scope=["system"]),
    rule(3, "phenotype", "phenotype", all=["system", "phenotype"], scope=["system"]),
]
#: Fixed rules of each kind of assay, by priority; all rules of the first priority that holds give their rows.
RULES = {
    "apol1": BY_SYSTEM,
    "blood_type": [
        rule(1, "blood_type", "blood_type", all=["system", "blood_type"], scope=["system"]),
        rule(1, "phenotype", "phenotype", all=["system", "phenotype"], none=["blood_type"], scope=["system"]),
        rule(1, "abo_genotype", "abo_genotype", systems=["ABO", "ABO/RhD summary"], scope=["system"], fallback="Unresolved"),
    ],
    "pgx1": [
        rule(0, "genotype", "genotype", some=["condition", "drug"], scope=["condition", "drug"], prefix="hla_allele", missing="missing", fallback="Unresolved"),
        rule(1, "", "", some=["hla_allele", "hla_proxy_status"]),
        rule(1, "hla_proxy_key", "hla_proxy_key", all=["hla_proxy_key"], none=["hla_allele", "hla_proxy_status"]),
        *BY_SYSTEM,
    ],
}


def rules(spark: SparkSession) -> DataFrame:
    """``(kind, rules)``: a row for each kind of assay."""
    return spark.createDataFrame([*RULES.items()], f"kind string, rules array<{RULE}>")


def analysis_values(rows: DataFrame, kinds: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``system``, ``result_key`` and ``result_value`` beside analysis rows ``(assay_id, ..., keys array, row map)``.

    ``kinds (assay_id, kind)`` says which rules of ``table`` (``rules()``) an assay has; one that isn't listed has none. A
    row for which a rule holds gives what the rules of the least such priority give, one row each. Any other gives the
    first emitted key with a value, or where none is emitted the first of the row's own plain values: of the keys that are
    named or end like a status, if there are any. Values are trimmed, and rows without any go.
    """
    table = rules(rows.sparkSession) if table is None else table
    value = lambda k: F.trim(F.coalesce(F.try_element_at("row", k if isinstance(k, Column) else F.lit(k)), F.lit("")))
    filled = lambda k: value(k) != ""

    def holds(r: Column) -> Column:
        listed = (F.size(r["systems"]) == 0) | F.array_contains(r["systems"], value("system"))
        return ((F.size(r["some"]) == 0) | F.exists(r["some"], filled)) & F.forall(r["all"], filled) & ~F.exists(r["none"], filled) & listed

    def given(r: Column) -> Column:
        scope = F.coalesce(F.get(F.filter(F.transform(r["scope"], value), lambda x: x != ""), F.lit(0)), F.lit(""))
        prefix = F.when(r["prefix"] == "", "").otherwise(value(r["prefix"]))
        key = F.when(prefix == "", r["key"]).otherwise(F.concat_ws("_", prefix, r["key"]))
        own = value(r["value"])
        return F.struct(scope.alias("system"), key.alias("result_key"), F.when((own == "") | ((r["missing"] != "") & (F.lower(own) == r["missing"])), r["fallback"]).otherwise(own).alias("result_value"))

    emitted = F.coalesce("keys", F.array().cast("array<string>"))
    plain = F.filter(F.map_keys("row"), lambda k: ~value(k).rlike(r"^[\[{]"))
    keys = F.filter(F.when(F.size(emitted) > 0, emitted).otherwise(plain), lambda k: ~k.isin(*NOISY_KEYS))
    status = F.filter(keys, lambda k: k.endswith("_status") | k.isin(*STATUS_KEYS))
    candidates = F.when(F.size(status) > 0, status).otherwise(keys)
    first = F.slice(F.filter(F.transform(candidates, lambda k: F.struct(F.lit("").alias("system"), k.alias("result_key"), value(k).alias("result_value"))), lambda x: x["result_value"] != ""), 1, 1)

    others = [c for c in rows.columns if c not in ("keys", "row")]
    known = F.broadcast(table)  # as many rows as there are kinds of assays
    with_rules = rows.join(kinds.select("assay_id", "kind"), "assay_id", "left").join(known, "kind", "left")
    held = F.filter(F.coalesce("rules", F.array().cast(f"array<{RULE}>")), holds)
    with_rules = with_rules.select(*others, "keys", "row", held.alias("held"))
    best = F.array_min(F.transform("held", lambda r: r["priority"]))
    by_rule = F.filter(F.transform(F.filter("held", lambda r: (r["priority"] == best) & (r["value"] != "")), given), lambda x: x["result_value"] != "")
    return with_rules.select(*others, F.explode(F.when(F.size("held") > 0, by_rule).otherwise(first)).alias("x")).select(*others, "x.*")


def gene_calls(reports: DataFrame) -> DataFrame:
    """``(participant_id, gene, label, phenotype, possible)`` from JSON reports with a ``genes`` map."""
    schema = "struct<genes:map<string,struct<sourceDiplotypes:array<struct<label:string,matchScore:double,phenotypes:array<string>>>>>>"
    genes = reports.select("participant_id", F.explode(F.from_json("json", schema)["genes"]).alias("gene", "call"))
    calls = F.col("call.sourceDiplotypes")
    return genes.select("participant_id", "gene", F.get(calls, F.lit(0))["label"].alias("label"), F.get(F.get(calls, F.lit(0))["phenotypes"], F.lit(0)).alias("phenotype"), L.possible_calls(F.transform(calls, lambda c: c["label"])).alias("possible"))
