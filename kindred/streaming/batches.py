"""Cohorts parsed in batches and finished later: each batch leaves its partial states, which are merged when all are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sexbias

STATES = ("counts", "stats")


def partial_counts(s: DataFrame) -> DataFrame:
    """``(region, rsid, chrom, pos, called, total, squares)`` of signals; a variant's place is its least."""
    sums = (F.count("*").alias("called"), F.sum("signal").alias("total"), F.sum(F.col("signal") * F.col("signal")).alias("squares"))
    return s.groupBy("region", "rsid").agg(F.min(F.struct("chrom", "pos")).alias("at"), *sums).select("region", "rsid", "at.chrom", "at.pos", "called", "total", "squares")


def write_batch(g: DataFrame, batch: str, folder: str) -> None:
    """The states of a batch's genotypes, below ``folder``: sums by variant, and figures by sample and chromosome.

    What an earlier attempt at the same batch left is replaced, so a batch that is taken again changes nothing. An empty
    batch leaves empty states. A null call or no-call adds nothing to sums.
    """
    rows = {"counts": partial_counts(sexbias.signals(g)), "stats": sexbias.chromosome_stats(g)}
    for name in STATES:
        rows[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sums by variant over all batches, with the place that the first batch by name has, and each sample's figures.

    A sample in several batches counts in the sums of each; of its figures those of the last batch by name stay.
    """
    counts, stats = (spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/*").withColumn("batch", F.col("batch").cast("string")) for name in STATES)
    sums = [F.sum(c).alias(c) for c in ("called", "total", "squares")]
    counts = counts.groupBy("region", "rsid").agg(F.min_by(F.struct("chrom", "pos"), "batch").alias("at"), *sums).select("region", "rsid", "at.chrom", "at.pos", "called", "total", "squares")
    last = stats.groupBy("sample_id", "chrom").agg(F.max_by(F.struct("n", "het_rate", "mean_gs", "var_gs"), "batch").alias("x"))
    return counts, last.select("sample_id", "chrom", "x.*")


def watch_genotypes(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of genotype rows as batches of their own; one that fails is taken again under its number."""

    def take(batch: DataFrame, n: int) -> None:
        write_batch(batch, f"b{n:09d}", folder)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
