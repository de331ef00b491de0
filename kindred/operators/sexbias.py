"""Sex-biased ancestry from heterozygosity and from components on the X and on autosomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..params import DEFAULT
from ..sources.shared import written

#: Samples whose weights (a few numbers each) are sent to every task of a factorisation.
MOST_SAMPLES = 1_000_000


def chromosome_stats(g: DataFrame) -> DataFrame:
    """``(sample_id, chrom, n, het_rate, mean_gs, var_gs)`` on chromosomes 1 to 22 and X; a no-call counts as not heterozygous."""
    rows = g.where(F.col("chrom").isin([*G.AUTOSOMES, "X"]))
    return rows.groupBy("sample_id", "chrom").agg(F.count("*").alias("n"), F.avg(G.heterozygous(F.col("gt")).cast("double")).alias("het_rate"), F.avg("gs").alias("mean_gs"), F.var_samp("gs").alias("var_gs"))


def compartments(stats: DataFrame) -> DataFrame:
    """``(sample_id, auto_het, x_het, auto_gs, x_gs)``: autosomes as the plain mean of their chromosomes' means."""
    auto, x = F.col("chrom") != "X", F.col("chrom") == "X"
    return stats.groupBy("sample_id").agg(*(F.avg(F.when(side, F.col(c))).alias(f"{name}_{short}") for c, short in (("het_rate", "het"), ("mean_gs", "gs")) for name, side in (("auto", auto), ("x", x))))


def by_sex(results: DataFrame, sexes: DataFrame) -> DataFrame:
    """``(sex, samples, auto_het, x_het, ratio)``; samples without a known sex are a row of their own."""
    rows = results.join(sexes, "sample_id", "left").groupBy("sex").agg(F.count("*").alias("samples"), F.avg("auto_het").alias("auto_het"), F.avg("x_het").alias("x_het"))
    return rows.withColumn("ratio", F.col("x_het") / F.nullif(F.col("auto_het"), F.lit(0.0)))


def signals(g: DataFrame) -> DataFrame:
    """``(sample_id, region, rsid, chrom, pos, signal)`` of SNP calls: 1 heterozygous, 0 not."""
    region = F.when(F.col("chrom") == "X", "x").when(F.col("chrom").isin(G.AUTOSOMES), "auto")
    return g.select("sample_id", region.alias("region"), "rsid", "chrom", "pos", G.signal(F.col("gt")).alias("signal")).where("region is not null and signal is not null")


def sample_filter(s: DataFrame, min_auto: int, min_x: int) -> DataFrame:
    """``(sample_id, auto, x, filter)``: pass, low_autosome_signal or low_x_signal."""
    rows = s.groupBy("sample_id").agg(F.count_if(F.col("region") == "auto").alias("auto"), F.count_if(F.col("region") == "x").alias("x"))
    return rows.withColumn("filter", F.when(F.col("auto") < min_auto, "low_autosome_signal").when(F.col("x") < min_x, "low_x_signal").otherwise("pass"))


def variant_filter(s: DataFrame, samples: int, least: float = DEFAULT.nmf_call_rate) -> DataFrame:
    """``(region, rsid, chrom, pos, called, call_rate, variance, filter)``; the call rate is capped at 1."""
    rows = s.groupBy("region", "rsid", "chrom", "pos").agg(F.count("*").alias("called"), F.sum("signal").alias("total"), F.sum(F.col("signal") * F.col("signal")).alias("squares"))
    mean = F.col("total") / F.col("called")
    rows = rows.withColumns({"call_rate": F.least(F.lit(1.0), F.col("called") / F.nullif(F.lit(samples), F.lit(0))), "variance": F.col("squares") / F.col("called") - mean * mean})
    label = F.when(F.col("call_rate") < least, "low_call_rate").when(F.col("variance") <= 0, "zero_variance").otherwise("pass")
    return rows.drop("total", "squares").withColumn("filter", label)


def merged_counts(parts: DataFrame) -> DataFrame:
    """Partial counts, sums and sums of squares by region and rsid, added up."""
    return parts.groupBy("region", "rsid").agg(F.sum("called").alias("called"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def nmf(s: DataFrame, k: int = 3, rounds: int = 30, inner: int = 40, seed: int = 42) -> DataFrame:
    """``(sample_id, component, q)``: a non-negative factorisation of samples by variants, the samples' weights scaled to 1."""
    names, w = weights(s, k, rounds, inner, seed)
    w = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
    found = [(x, c, float(w[i, c])) for i, x in enumerate(names) for c in range(k)]
    return s.sparkSession.createDataFrame(found, f"sample_id {s.schema['sample_id'].dataType.simpleString()}, component int, q double")


def weights(s: DataFrame, k: int = 3, rounds: int = 30, inner: int = 40, seed: int = 42) -> tuple[list, np.ndarray]:
    """Samples in order, and their ``k`` weights each.

    Missing signals are 0.5. In each round every variant fits its ``k`` loadings to the samples' weights and adds what the
    weights need to sums over variants, in its own task; the sums (``k`` numbers a sample, and a matrix of ``k`` by ``k``)
    then give the next weights. So calls stay where they are, and only weights travel. Both steps are multiplicative
    updates, which never raise the error, from starts that repeat.
    """
    names = [r[0] for r in s.select("sample_id").distinct().orderBy("sample_id").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"the weights of at most {MOST_SAMPLES} samples are sent to the tasks")
    kind = s.schema["sample_id"].dataType.simpleString()
    places = F.broadcast(s.sparkSession.createDataFrame([(x, n) for n, x in enumerate(names)], f"sample_id {kind}, k int"))
    rows = s.join(places, "sample_id").groupBy("rsid").agg(F.collect_list("k").alias("k"), F.collect_list((F.col("signal") - 0.5).cast("float")).alias("v"))
    rows = written(rows.select("k", "v"))
    w = np.random.default_rng(seed).random((len(names), k)) + 0.1

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X times H transposed, and H times H transposed, for the loadings H that fit the weights."""
        shared = s.sparkSession.sparkContext.broadcast(w)

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = shared.value
            xh, hh, ww, halves = np.zeros_like(w), np.zeros((k, k)), w.T @ w, 0.5 * w.sum(0)
            for b in batches:
                if not len(b):
                    continue
                lengths = b["k"].map(len).to_numpy()
                at, v = np.concatenate(b["k"].to_list()), np.concatenate(b["v"].to_list()).astype(float)
                variant = np.repeat(np.arange(len(b)), lengths)
                wx = np.stack([np.bincount(variant, v * w[at, c], len(b)) for c in range(k)], 1) + halves
                h = np.full((len(b), k), 0.5)
                for _ in range(inner):
                    h *= wx / np.maximum(h @ ww, 1e-12)
                xh += np.stack([np.bincount(at, v * h[variant, c], len(w)) for c in range(k)], 1) + 0.5 * h.sum(0)
                hh += h.T @ h
            yield pd.DataFrame({"row": np.arange(len(w) + k), **{f"c{c}": np.concatenate([xh[:, c], hh[:, c]]) for c in range(k)}})

        columns = [f"c{c}" for c in range(k)]
        parts = rows.mapInPandas(fit, ", ".join(["row long", *(f"{c} double" for c in columns)]))
        found = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("row")[columns].to_numpy()
        shared.unpersist()
        return (found[: len(w)], found[len(w) :]) if len(found) else (np.ones_like(w), np.eye(k))

    for _ in range(rounds if names else 0):
        xh, hh = sums(w)
        for _ in range(inner):
            w = w * xh / np.maximum(w @ hh, 1e-12)
    return names, w
