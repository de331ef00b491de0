"""Line-level checks of genotype text, and reports over them. Lines are ``(participant_id, file, line_number, line)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import labels as L

# Fixed codes of the reports.
FILE_CODES = [
    "FILE_NOT_FOUND", "NOT_A_FILE", "FILE_NOT_READABLE", "FILE_EMPTY", "NO_DATA_ROWS", "READ_EXCEPTION", "SNIFF_EXCEPTION", "NORMALIZER_EXCEPTION",
    "UNEXPECTED_QC_EXCEPTION", "QC_PROCESS_EXIT", "ILLUMINA_MISSING_COLUMNS", "ILLUMINA_NO_HEADER", "ILLUMINA_NO_DATA_SECTION",
]
ILLUMINA_NEEDED = ["SNP Name", "Chr", "Position", "Allele1 - Plus", "Allele2 - Plus"]
HEADER = ["rsid", "chrom", "pos", "gt", "gs", "baf", "lrr"]
INTEGER = r"^[+-]?[0-9]{1,18}$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
NONFINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


def issue(when: Column, severity: Column | str, code: str) -> Column:
    return F.when(when, F.struct((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(code).alias("code")))


def fields_of(line: str = "line") -> Column:
    return F.split(F.regexp_replace(line, r"[\r\n]+$", ""), "\t")


def field(k: int) -> Column:
    return F.trim(F.coalesce(F.get("fields", F.lit(k)), F.lit("")))


def ddna_rows(lines: DataFrame) -> DataFrame:
    """Data lines with ``fields``: no blanks, comments or header."""
    text = F.trim(F.regexp_replace("line", r"[\r\n]+$", ""))
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("fields", fields_of())
    names = F.transform(F.slice("fields", 1, 7), lambda f: F.lower(F.regexp_replace(F.trim(f), "^﻿", "")))
    return rows.withColumn("is_header", names == F.array(*map(F.lit, HEADER)))


def ddna_issues(lines: DataFrame) -> DataFrame:
    """``(participant_id, file, line_number, severity, code, line)``: a row an issue.

    Conditions are one array a line, so a file is read once; only duplicates need a window, by file and rsid.
    """
    rows = ddna_rows(lines)
    rsid, chrom, pos, gt = field(0), field(1), field(2), field(3)
    clean, kind = G.clean_chrom(chrom), G.genotype_class(gt)
    few, vendor = F.size("fields") < 7, F.trim(F.coalesce(F.get("fields", F.lit(3)), F.lit(""))).isin(G.VENDOR_MISSING)
    data, sound = ~F.col("is_header"), ~F.col("is_header") & ~few & ~vendor
    whole = pos.rlike(INTEGER)
    checks = [
        issue(F.col("line").contains("\u0000"), "ERROR", "NUL_BYTE"),
        issue(F.col("is_header") & F.get("fields", F.lit(0)).startswith("﻿"), "WARNING", "UTF8_BOM"),
        issue(F.col("is_header") & few, "ERROR", "DDNA_HEADER_FIELD_COUNT"),
        issue(data & few & (F.size("fields") == 1) & F.get("fields", F.lit(0)).contains(","), "ERROR", "POSSIBLE_CSV"),
        issue(data & few, "ERROR", "DDNA_FIELD_COUNT"),
        issue(data & ~few & vendor, "QUALITY", "DDNA_VENDOR_NO_CALL_ROW"),
        issue(sound & (clean == "0"), "QUALITY", "UNMAPPED_CHROM"),
        issue(sound & (clean != "0") & ~clean.isin(G.CHROMOSOMES_WITH_PAR), "ERROR", "INVALID_CHROM"),
        issue(sound & ~whole, "ERROR", "INVALID_POSITION"),
        issue(sound & whole & (pos.try_cast("bigint") <= 0), "QUALITY", "UNMAPPED_POSITION"),
        issue(sound & (gt == ""), "ERROR", "MISSING_GENOTYPE"),
        issue(sound & (gt != "") & (kind == "invalid"), "ERROR", "INVALID_GENOTYPE"),
    ]
    for k, name in ((4, "GS"), (5, "BAF"), (6, "LRR")):
        v = field(k)
        odd = v.rlike(NONFINITE)
        excused = (kind == "no_call") & F.lit(name != "GS")
        checks += [issue(sound & (v == ""), "WARNING", f"MISSING_{name}"), issue(sound & (v != "") & ~odd & ~v.rlike(NUMBER), "WARNING", f"INVALID_{name}"), issue(sound & odd & ~excused, "WARNING", f"NONFINITE_{name}")]
    signature = F.struct(clean.alias("c"), pos.alias("p"), F.upper(gt).alias("g"), (kind == "indel").alias("indel"))
    counted = F.when(sound & ~rsid.isin("", ".", "-"), rsid)
    rows = rows.withColumns({"known": counted, "signature": signature})
    # A line without an rsid is alone under its own number, so all lines go through one window and none meet in one task.
    seen = Window.partitionBy("file", "known", F.when(F.col("known").isNull(), F.col("line_number"))).orderBy("line_number")
    rows = rows.withColumns({"first": F.first("signature").over(seen), "first_line": F.first("line_number").over(seen)})
    again = F.col("line_number") > F.col("first_line")
    same = (F.col("first.c") == F.col("signature.c")) & (F.col("first.p") == F.col("signature.p")) & (F.col("first.g") == F.col("signature.g"))
    conflict = F.when(F.col("first.indel") | F.col("signature.indel"), "QUALITY").otherwise("ERROR")
    checks += [issue(again & same, "WARNING", "DUPLICATE_RSID"), issue(again & ~same, conflict, "CONFLICTING_DUPLICATE_RSID")]
    found = rows.select("participant_id", "file", "line_number", F.explode(F.array_compact(F.array(*checks))).alias("x"), L.report_line(F.col("line")).alias("line"))
    return found.select("participant_id", "file", "line_number", "x.severity", "x.code", "line")


def structural(lines: DataFrame) -> DataFrame:
    """Lines that no reader can trust: NUL bytes, an odd number of quotes, too few fields, commas for tabs."""
    rows = ddna_rows(lines).where(~F.col("is_header"))
    n = F.size("fields")
    checks = F.array_compact(
        F.array(
            F.when(F.col("line").contains("\u0000"), "nul"),
            F.when(F.regexp_count("line", F.lit('"')) % 2 == 1, "odd_quotes"),
            F.when(n < 7, "few_fields"),
            F.when((n == 1) & F.col("line").contains(","), "looks_like_csv"),
        )
    )
    return rows.select("file", "line_number", F.explode(checks).alias("problem"))


def file_issues(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Issues of whole files ``(participant_id, file, bytes)``: empty ones, and those without a data row; line 0."""
    rows = ddna_rows(lines).where(~F.col("is_header")).groupBy("file").agg(F.count("*").alias("rows"))
    code = F.when(F.coalesce("bytes", F.lit(0)) == 0, "FILE_EMPTY").when(F.coalesce("rows", F.lit(0)) == 0, "NO_DATA_ROWS")
    found = files.join(rows, "file", "left").withColumn("code", code).where("code is not null")
    return found.select("participant_id", "file", F.lit(0).alias("line_number"), F.lit("ERROR").alias("severity"), "code", F.lit("").alias("line"))


def is_file_level() -> Column:
    return (F.col("line_number") <= 0) | F.col("code").isin(FILE_CODES)


def split_errors(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors of files, and of rows."""
    errors = issues.where("severity = 'ERROR'")
    return errors.where(is_file_level()), errors.where(~is_file_level())


def file_status(files: DataFrame, issues: DataFrame) -> DataFrame:
    """``(file, errors, warnings, status)``: FAIL with an error, WARN with a warning or quality note, else PASS."""
    counts = issues.groupBy("file").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity").isin("WARNING", "QUALITY")).alias("warnings"))
    rows = files.select("file").distinct().join(counts, "file", "left").na.fill(0, ["errors", "warnings"])
    return rows.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))


def facet_counts(records: DataFrame) -> DataFrame:
    """``(facet, value, count)`` of records' ``facets`` maps; missing values as <MISSING>."""
    rows = records.select(F.explode("facets").alias("facet", "v"))
    return rows.groupBy("facet", F.when(L.missing_facet(F.col("v")), "<MISSING>").otherwise(F.trim("v")).alias("value")).count()


def run_report(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, those with file and row errors, distinct bad lines, and the percentage that can be used."""
    errors = issues.where("severity = 'ERROR'")
    bad = errors.agg(
        F.count_distinct(F.when(is_file_level(), F.col("file"))).alias("files_with_file_errors"),
        F.count_distinct(F.when(~is_file_level(), F.col("file"))).alias("files_with_row_errors"),
        F.count_distinct(F.when(~is_file_level(), F.struct("file", "line_number"))).alias("bad_lines"),
    )
    total = files.agg(F.count_distinct("file").alias("files"))
    return total.join(bad).withColumn("usable_percent", G.percent(F.col("files") - F.col("files_with_file_errors"), F.col("files")))


def union_reports(parts: list[DataFrame]) -> DataFrame:
    """Reports of several runs; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def illumina_issues(lines: DataFrame) -> DataFrame:
    """As ``ddna_issues`` for reports with a [Data] section; columns are found by name in each file's header."""
    text = F.trim(F.regexp_replace("line", r"[\r\n]+$", ""))
    rows = lines.withColumn("text", text)
    start = rows.where("text = '[Data]'").groupBy("file").agg(F.min("line_number").alias("start"))
    body = rows.join(start, "file").where("line_number > start and text <> ''").withColumn("fields", fields_of())
    head = body.groupBy("file").agg(F.min_by(F.struct("line_number", "fields"), "line_number").alias("head"))
    head = head.select("file", F.col("head.line_number").alias("head_line"), F.col("head.fields").alias("names"))
    at = {n: F.array_position("names", n) for n in ILLUMINA_NEEDED}
    complete = reduce(lambda a, b: a & b, (p > 0 for p in at.values()))
    rows = body.join(head, "file").withColumn("complete", complete)
    value = {n: F.trim(F.coalesce(F.get("fields", (p - 1).cast("int")), F.lit(""))) for n, p in at.items()}
    probe, chrom, pos, a1, a2 = value.values()
    data = F.col("line_number") > F.col("head_line")
    few = data & (F.size("fields") < F.size("names"))
    sound = data & ~few & F.col("complete")
    rows = rows.withColumn("probe", F.when(sound & (probe != ""), probe))
    firsts = rows.where("probe is not null").groupBy("file", "probe").agg(F.min("line_number").alias("first_line"))
    rows = rows.join(firsts, ["file", "probe"], "left")
    gt, clean = F.concat(a1, a2), G.clean_chrom(chrom)
    checks = F.array_compact(
        F.array(
            issue(~data & ~F.col("complete"), "ERROR", "ILLUMINA_MISSING_COLUMNS"),
            issue(few, "ERROR", "ILLUMINA_FIELD_COUNT"),
            issue(sound & (probe == ""), "ERROR", "MISSING_PROBE_ID"),
            issue(F.col("line_number") > F.col("first_line"), "WARNING", "DUPLICATE_PROBE"),
            issue(sound & (clean != "0") & ~clean.isin(G.CHROMOSOMES_WITH_PAR), "ERROR", "INVALID_CHROM"),
            issue(sound & ~pos.rlike(INTEGER), "ERROR", "INVALID_POSITION"),
            issue(sound & ((a1 == "") | (a2 == "")), "ERROR", "MISSING_ALLELE"),
            issue(sound & (a1 != "") & (a2 != "") & (G.genotype_class(gt) == "invalid"), "ERROR", "INVALID_GENOTYPE"),
        )
    )
    found = rows.select("participant_id", "file", "line_number", F.explode(checks).alias("x"), L.report_line(F.col("line")).alias("line")).select("participant_id", "file", "line_number", "x.severity", "x.code", "line")
    files = lines.select("participant_id", "file").distinct().join(start, "file", "left").join(head, "file", "left").join(rows.where(data).groupBy("file").agg(F.count("*").alias("n")), "file", "left")
    code = F.when(F.col("start").isNull(), "ILLUMINA_NO_DATA_SECTION").when(F.col("head_line").isNull(), "ILLUMINA_NO_HEADER").when(F.coalesce("n", F.lit(0)) == 0, "NO_DATA_ROWS")
    return found.unionByName(files.withColumn("code", code).where("code is not null").select("participant_id", "file", F.lit(0).alias("line_number"), F.lit("ERROR").alias("severity"), "code", F.lit("").alias("line")))
