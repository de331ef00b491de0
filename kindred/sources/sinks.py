"""Writers: reports as tables of text, frequencies by population, and audits with joined reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import qc


def six(c: str) -> Column:
    """Six decimals, for text only."""
    return F.format_string("%.6f", F.col(c)).alias(c)


def write_tsv(df: DataFrame, path: str) -> None:
    """Headed tab-separated text, floating-point numbers with six decimals."""
    df.select(*(six(c) if t in ("double", "float") else c for c, t in df.dtypes)).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")


def write_reports(files: DataFrame, issues: DataFrame, path: str) -> None:
    """The report set: summary, issues, errors by kind, warnings, quality notes, and the run in JSON.

    Issues are written first and the views read them, so that lines are parsed once.
    """
    issues.write.mode("overwrite").parquet(f"{path}/issues.parquet")
    issues = issues.sparkSession.read.parquet(f"{path}/issues.parquet")
    of_files, of_rows = qc.split_errors(issues)
    views = {
        "summary": qc.file_status(files, issues),
        "issues": issues,
        "errors": issues.where("severity = 'ERROR'"),
        "file_errors": of_files,
        "row_errors": of_rows,
        "warnings": issues.where("severity = 'WARNING'"),
        "quality": issues.where("severity = 'QUALITY'"),
    }
    for name, view in views.items():
        write_tsv(view, f"{path}/{name}")
    qc.run_report(files, issues).write.mode("overwrite").json(f"{path}/report")


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Headed tab-separated text whose parts follow each other in ``order``, as reports by country, participant and gene do."""
    write_tsv(df.orderBy(*order, *(c for c in df.columns if c not in order)), path)


def write_populations(af: DataFrame, path: str) -> list[str]:
    """``<path>/allele_freq_<pop>.tsv`` folders of headed text, one a population, as ``population_files`` reads them."""
    made = []
    for (pop,) in af.select("pop").distinct().orderBy("pop").collect():  # populations are few
        made.append(f"{path}/allele_freq_{pop}.tsv")
        rows = af.where(F.col("pop") == pop).select("locus_key", "rsid", "allele_freq", F.col("allele_number").cast("long"))
        rows.write.mode("overwrite").csv(made[-1], sep="\t", header=True)
    return made


def variant_audit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Used variants, and dropped ones with their reasons."""
    return rows.where("stage = 'used'"), rows.where("stage = 'dropped'")


def matrix_preview(d: DataFrame, samples: list, variants: int = 100) -> DataFrame:
    """The first ``variants`` variants as a wide table of ``samples``: a look, not a format."""
    some = d.select("rsid").distinct().orderBy("rsid").limit(variants)
    return d.join(F.broadcast(some), "rsid").groupBy("rsid").pivot("sample_id", samples).agg(F.first("dosage"))


def java_double(c: str) -> Column:
    """A double in the JVM's own notation."""
    return F.col(c).cast("string")
