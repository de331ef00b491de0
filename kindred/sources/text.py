"""Genotype text files as rows: sniffing, parsing and normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators.qc import INTEGER, NUMBER, ddna_rows, field, fields_of
from .ranges import RANGE_BYTES, listed, numbered_lines

PARTICIPANT = r"([^/]+)/[^/]*$"
ALIASES = {"rsid": ["rsid", "id"], "chrom": ["chrom", "chromosome", "chr"], "pos": ["pos", "position"], "gt": ["genotype", "gt"]}
ID_NAMES, PATH_NAMES = ["participant_id", "sample_id", "id"], ["genotype_file", "path", "file"]


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(participant_id, file, line_number, line)`` of the files under ``path``; the participant is the folder's name.

    Files are read by byte ranges, many tasks a file, and block-gzipped ones at their blocks. A file that can't be read
    to its end gives its lines up to there; ``discovery.scan`` also tells which those are.
    """
    rows = numbered_lines(spark, listed(path, glob), range_bytes).where("problem is null")
    return rows.select(F.regexp_extract("file", PARTICIPANT, 1).alias("participant_id"), "file", "line_number", "line")


def list_files(spark: SparkSession, path: str, glob: str = "*.txt*") -> DataFrame:
    """``(participant_id, file, bytes)`` without reading the contents; files of no bytes, which scans skip, are listed too."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = spark.createDataFrame([(f,) for f in rows.inputFiles()], "file string")
    sizes = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return names.join(sizes, "file", "left").select(F.regexp_extract("file", PARTICIPANT, 1).alias("participant_id"), "file", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def first_file(files: DataFrame) -> DataFrame:
    """The first file by name of each participant."""
    return files.groupBy("participant_id").agg(F.min("file").alias("file"))


def sniff(lines: DataFrame) -> DataFrame:
    """``(file, format)`` from each file's first line that isn't blank: illumina or ddna."""
    text = F.trim(F.regexp_replace("line", r"[\r\n]+$", ""))
    first = lines.groupBy("file").agg(F.min_by(F.when(text != "", text), F.when(text != "", F.col("line_number"))).alias("first"))
    return first.select("file", F.when(F.col("first").isin("[Header]", "[Data]"), "illumina").otherwise("ddna").alias("format"))


def delimiter(lines: DataFrame) -> DataFrame:
    """``(file, delimiter)`` from the first line that is neither blank nor a comment."""
    good = (F.trim("line") != "") & ~F.trim("line").startswith("#")
    first = lines.where(good).groupBy("file").agg(F.min_by("line", "line_number").alias("first"))
    return first.select("file", F.when(F.regexp_count("first", F.lit(",")) > F.regexp_count("first", F.lit("\t")), ",").otherwise("\t").alias("delimiter"))


def number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def normalised(rows: DataFrame, locus_map: DataFrame | None = None) -> DataFrame:
    """Canonical rows of ``(participant_id, file, line_number, rsid, chrom, pos, gt, gs, baf, lrr)`` in text.

    A blank id drops the row before ids are made canonical, while a dot or dash takes its locus as id. Rows with the
    vendor's missing value, without a positive whole position, or with an unknown chromosome or genotype go.
    """
    rows = rows.withColumn("rsid", F.regexp_replace(F.trim("rsid"), "^﻿+", ""))
    rows = rows.where((F.col("rsid") != "") & (F.lower("rsid") != "rsid") & ~F.trim("gt").isin(G.VENDOR_MISSING))
    position = F.trim("pos")
    rows = rows.select(
        "participant_id", "file", "line_number", G.canonical_rsid(F.col("rsid")).alias("rsid"), G.clean_chrom(F.col("chrom")).alias("chrom"), F.when(position.rlike(INTEGER), position.try_cast("bigint")).alias("pos"),
        G.genotype(F.col("gt")).alias("gt"), *(number(F.trim(c)).alias(c) for c in ("gs", "baf", "lrr")),
    )
    rows = rows.where((F.col("pos") > 0) & F.col("chrom").isin(G.CHROMOSOMES_WITH_PAR) & G.valid_genotype(F.col("gt")))
    mapped = None
    if locus_map is not None:
        known = locus_map.select("chrom", "pos", F.col("rsid").alias("mapped"))
        rows, mapped = rows.join(known, ["chrom", "pos"], "left"), F.col("mapped")
    rows = rows.withColumns({"probe_id": F.col("rsid"), "variant_id": G.variant_id(F.col("rsid"), F.col("chrom"), F.col("pos"), mapped)})
    return rows.select("participant_id", "file", "line_number", "variant_id", "rsid", "probe_id", "chrom", "pos", "gt", "gs", "baf", "lrr")


def ddna(lines: DataFrame, locus_map: DataFrame | None = None) -> DataFrame:
    """Canonical rows of tab-separated files; fields by position, further ones ignored, short lines dropped."""
    rows = ddna_rows(lines).where(~F.col("is_header") & (F.size("fields") >= 7))
    names = ["rsid", "chrom", "pos", "gt", "gs", "baf", "lrr"]
    return normalised(rows.select("participant_id", "file", "line_number", *(field(k).alias(n) for k, n in enumerate(names))), locus_map)


def illumina(lines: DataFrame, locus_map: DataFrame | None = None) -> DataFrame:
    """Canonical rows of reports with a [Data] section, replicate probes merged."""
    rows = lines.withColumn("text", F.trim(F.regexp_replace("line", r"[\r\n]+$", "")))
    start = rows.where("text = '[Data]'").groupBy("file").agg(F.min("line_number").alias("start"))
    body = rows.join(start, "file").where("line_number > start and text <> ''").withColumn("fields", fields_of())
    head = body.groupBy("file").agg(F.min_by(F.struct("line_number", "fields"), "line_number").alias("head")).select("file", F.col("head.line_number").alias("head_line"), F.col("head.fields").alias("names"))
    rows = body.join(head, "file").where("line_number > head_line and size(fields) >= size(names)")

    def value(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.trim(F.get("fields", at - 1)))

    probe, rsid = value("SNP Name"), G.extract_rsid(value("SNP Name"))
    rows = rows.select(
        "participant_id", "file", "line_number", probe.alias("probe"), F.when(rsid == "", ".").otherwise(rsid).alias("rsid"), value("Chr").alias("chrom"), value("Position").alias("pos"),
        G.genotype_of(value("Allele1 - Plus"), value("Allele2 - Plus")).alias("gt"), F.coalesce(value("GC Score"), F.lit("")).alias("gs"), F.coalesce(value("B Allele Freq"), F.lit("")).alias("baf"), F.coalesce(value("Log R Ratio"), F.lit("")).alias("lrr"),
    ).where("probe <> '' and chrom is not null and pos is not null")
    return merge_replicates(normalised(rows, locus_map))


def merge_replicates(rows: DataFrame) -> DataFrame:
    """One row a participant, file and variant: a no-call where calls differ, or where one replicate is a no-call.

    Of the rows the last is kept, calls sorted before no-calls.
    """
    key = ["participant_id", "file", "variant_id"]
    call = F.when(F.col("gt") != G.NO_CALL, F.col("gt"))
    # An aggregation, so that a participant's rows are reduced to one a variant before they are shuffled.
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct(F.col("gt") == G.NO_CALL, "line_number"))
    found = rows.groupBy(*key).agg(last.alias("x"), F.min(call).alias("least"), F.max(call).alias("most"))
    gt = F.when(F.col("least") != F.col("most"), G.NO_CALL).otherwise(F.col("x.gt"))
    return found.select(*(c if c in key else gt.alias(c) if c == "gt" else f"x.{c}" for c in rows.columns))


def named(df: DataFrame, aliases: dict[str, list[str]], needed: list[str]) -> DataFrame:
    """Columns renamed by the first alias that a table has; an error names those it lacks."""
    have = {c.strip().lower(): c for c in df.columns}
    found = {k: next((have[a] for a in names if a in have), None) for k, names in aliases.items()}
    if missing := [k for k in needed if not found[k]]:
        raise ValueError(f"no column for {missing} among {df.columns}")
    return df.select(*(F.col(f"`{v}`").alias(k) for k, v in found.items() if v))


def simple_table(spark: SparkSession, path: str, locus_map: DataFrame | None = None, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Canonical rows, as ``normalised`` gives them, of tables with a header line, columns by alias.

    Each file's delimiter is found from its first line that is neither blank nor a comment, which is its header; a byte
    order mark before it is dropped. Files are read by ranges. A file whose header lacks a column, or that can't be read to
    its end, is an error. Fields may stand in double quotes.
    """
    rows = numbered_lines(spark, listed(path, glob), range_bytes)
    rows = rows.select("file", "line_number", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "file", "problem"))).otherwise(F.regexp_replace("line", "^\ufeff+", "")).alias("line"))
    rows = rows.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    head = rows.groupBy("file").agg(F.min_by(F.struct("line_number", "line"), "line_number").alias("head")).select("file", F.col("head.line_number").alias("head_line"), F.col("head.line").alias("head"))
    comma = F.regexp_count("head", F.lit(",")) > F.regexp_count("head", F.lit("\t"))
    names = F.transform(split_fields(F.col("head"), comma), lambda x: F.lower(F.trim(x)))
    head = head.select("file", "head_line", comma.alias("comma"), names.alias("names"))
    place = {k: F.coalesce(*(F.nullif(F.array_position("names", a), F.lit(0)) for a in aliases)).cast("int") for k, aliases in ALIASES.items()}
    lacks = F.concat_ws(", ", *(F.when(at.isNull(), k) for k, at in place.items()))
    head = head.select("file", "head_line", "comma", *(F.when(lacks != "", F.raise_error(F.concat(F.lit("no column for "), lacks, F.lit(" in "), F.col("file")))).otherwise(at).alias(f"at_{k}") for k, at in place.items()))
    rows = rows.join(head, "file").where("line_number > head_line").withColumn("fields", split_fields(F.col("line"), F.col("comma")))
    fields = rows.select(
        F.regexp_extract("file", PARTICIPANT, 1).alias("participant_id"), "file", "line_number", *(F.coalesce(F.get("fields", F.col(f"at_{k}") - 1), F.lit("")).alias(k) for k in ALIASES),
        *(F.lit(None).cast("string").alias(k) for k in ("gs", "baf", "lrr")),
    )
    return normalised(fields, locus_map)


def split_fields(line: Column, comma: Column) -> Column:
    """A line's fields by commas or tabs; one in double quotes may hold the delimiter, and a doubled quote is one."""
    cut = lambda d: F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(rf'{d}("(?:[^"]|"")*"|[^{d}]*)'), 1)
    bare = lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(F.when(comma, cut(",")).otherwise(cut("\t")), bare)


def samplesheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(participant_id, path, facets)``; columns beside id and path are facets.

    Values are trimmed. A blank id becomes row_<n>, counted in lines with the header as the first. A blank path stays
    blank, and others are taken from the samplesheet's folder unless they are absolute.
    """
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    have = {c.strip().lower(): c for c in df.columns}
    who, where = (next((have[a] for a in names if a in have), None) for names in (ID_NAMES, PATH_NAMES))
    if not where:
        raise ValueError(f"no column for the file among {df.columns}")
    rest = [c for c in df.columns if c not in (who, where)]
    facets = F.create_map(*(x for c in rest for x in (F.lit(c), F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))))) if rest else F.create_map().cast("map<string,string>")
    # The number of a row in its file: splits in order of their start, a split's rows as they are read. A samplesheet has a
    # row a participant, so one window over it is small.
    order = Window.orderBy("_metadata.file_path", "_metadata.file_block_start", "at")
    df = df.withColumn("at", F.monotonically_increasing_id()).withColumn("n", F.row_number().over(order))
    own = F.nullif(F.trim(F.col(f"`{who}`")), F.lit("")) if who else F.lit(None).cast("string")
    path_column = F.trim(F.coalesce(F.col(f"`{where}`"), F.lit("")))
    folder = path.rsplit("/", 1)[0]
    full = F.when(path_column.rlike("^(/|[a-z0-9]+:|$)"), path_column).otherwise(F.concat(F.lit(folder + "/"), path_column))
    return df.select(F.coalesce(own, F.concat(F.lit("row_"), (F.col("n") + 1).cast("string"))).alias("participant_id"), full.alias("path"), facets.alias("facets"))


def locus_map(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(chrom, pos, rsid)`` of a table, without loci that have several rsids."""
    from ..operators.popgen import unambiguous_map

    rows = named(spark.read.csv(path, sep=sep, header=True, inferSchema=False), {k: ALIASES[k] for k in ("rsid", "chrom", "pos")}, ["rsid", "chrom", "pos"])
    return unambiguous_map(rows.withColumn("pos", F.when(F.trim("pos").rlike(INTEGER), F.trim("pos").try_cast("bigint"))))


def probes(rows: DataFrame) -> DataFrame:
    """Flags of array probes ``(probe_id, design, chrom, pos)``: what their names say, and whether they have a place."""
    rsid = G.extract_rsid(F.col("probe_id"))
    return rows.withColumn("rsid", rsid).withColumns({
        "has_rsid": rsid != "",
        "plain_rsid": F.col("probe_id") == rsid,
        "prefixed_or_suffixed": (rsid != "") & (F.col("probe_id") != rsid),
        "non_rsid": rsid == "",
        "duplicate_probe": F.col("probe_id").contains("_ilmndup"),
        "cnv_probe": F.col("probe_id").contains("CNV"),
        "unmapped": F.col("chrom").isin("", "0") | (F.col("pos") == 0),
    })


def summary(rows: DataFrame) -> DataFrame:
    """One row on canonical rows: how many, distinct variants and rsids, no-calls, and rows named by their locus."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_distinct("variant_id").alias("variants"),
        F.count_distinct(F.nullif(F.col("rsid"), F.lit(""))).alias("rsids"),
        F.count_if(F.col("gt") == G.NO_CALL).alias("no_calls"),
        F.count_if(F.col("variant_id").contains(":")).alias("by_locus"),
    )


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two files: variants shared, and in one only. Each side is grouped once, on one key."""
    sides = a.select("variant_id", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("variant_id", F.lit(0).alias("x"), F.lit(1).alias("y")))
    each = sides.groupBy("variant_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(total("x").alias("left_rows"), total("y").alias("right_rows"), F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("shared"), F.count_if(F.col("y") == 0).alias("left_only"), F.count_if(F.col("x") == 0).alias("right_only"))


def snp_positions(lines: DataFrame) -> DataFrame:
    """``(name, chrom, pos)`` of a final report's probes, the first row of each name."""
    rows = illumina_fields(lines, {"name": ["Name", "SNP Name"], "chrom": ["Chr", "Chromosome"], "pos": ["Position", "MapInfo"]})
    rows = rows.where("name <> ''")
    best = rows.groupBy("name").agg(F.min_by(F.struct("chrom", "pos"), F.struct("file", "line_number")).alias("x"))
    return best.select("name", "x.chrom", F.when(F.col("x.pos").rlike(INTEGER), F.col("x.pos").try_cast("bigint")).alias("pos"))


def illumina_fields(lines: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """``(participant_id, file, line_number, ...)`` of a report's data lines: columns by the first header name that is there.

    Data begin after a [Data] line, or with the first line of a file without one.
    """
    rows = lines.withColumn("text", F.trim(F.regexp_replace("line", r"[\r\n]+$", ""))).where("text <> ''")
    start = rows.groupBy("file").agg(F.coalesce(F.min(F.when(F.col("text") == "[Data]", F.col("line_number"))), F.lit(0)).alias("start"))
    body = rows.join(start, "file").where("line_number > start").withColumn("fields", fields_of())
    head = body.groupBy("file").agg(F.min_by(F.struct("line_number", "fields"), "line_number").alias("head"))
    body = body.join(head, "file").where(F.col("line_number") > F.col("head.line_number"))

    def value(aliases: list[str]) -> Column:
        at = F.coalesce(*(F.nullif(F.array_position("head.fields", a), F.lit(0)) for a in aliases)).cast("int")
        return F.trim(F.coalesce(F.get("fields", at - 1), F.lit("")))

    return body.select("participant_id", "file", "line_number", *(value(a).alias(k) for k, a in names.items()))
