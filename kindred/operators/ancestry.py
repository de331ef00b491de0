"""Ancestry proportions (rows sample, component, q): labelling components, comparing X with autosomes, choosing K."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from ..sources.shared import by_files, discard, written
from . import admix
from .linalg import added_up


def framed(q: DataFrame, labels: DataFrame, sexes: DataFrame) -> DataFrame:
    """``q`` with ``superpopulation``, ``sex`` and ``grp``: reference where the sample is labelled, else study."""
    rows = q.join(labels.select("sample_id", "superpopulation"), "sample_id", "left").join(sexes.select("sample_id", "sex"), "sample_id", "left")
    return rows.withColumn("grp", F.when(F.col("superpopulation").isNotNull(), "reference").otherwise("study"))


def component_labels(frame: DataFrame) -> DataFrame:
    """``(component, label)``: the superpopulation with the highest mean q, the first by name of equals.

    A label's later components get _2, _3 and so on, in order of component.
    """
    means = frame.where("grp = 'reference'").groupBy("component", "superpopulation").agg(F.avg("q").alias("mean_q"))
    best = first_best(means, "component", "superpopulation")
    nth = F.row_number().over(Window.partitionBy("superpopulation").orderBy("component"))
    label = F.when(nth == 1, F.col("superpopulation")).otherwise(F.concat_ws("_", "superpopulation", nth.cast("string")))
    return best.select("component", label.alias("label"))


def first_best(means: DataFrame, key: str, of: str) -> DataFrame:
    """``(key, of, mean_q)`` with the greatest mean, ties to the least ``of``."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("mean_q").desc(), of))
    return means.withColumn("nth", best).where("nth = 1").drop("nth")


def anchored_labels(q: DataFrame, anchors: DataFrame, least: int = 3) -> DataFrame:
    """``(label, component, mean_q, anchors)``: the best component of each label with ``least`` anchors at least."""
    joined = anchors.join(q, "sample_id")
    means = joined.groupBy("label", "component").agg(F.avg("q").alias("mean_q"), F.count_distinct("sample_id").alias("anchors")).where(F.col("anchors") >= least)
    return first_best(means, "label", "component")


def x_against_autosomes(auto: DataFrame, x: DataFrame, group: str = "study") -> DataFrame:
    """``(label, mean_auto, mean_x, delta, mean_x_female, mean_x_male)`` for labels that both have, four decimals.

    Frames are ``(sample_id, label, q, sex, grp)``; sexes are 2 for females and 1 for males.
    """
    a = auto.where(F.col("grp") == group).groupBy("label").agg(F.avg("q").alias("auto"))
    b = x.where(F.col("grp") == group).groupBy("label").agg(F.avg("q").alias("x"), F.avg(F.when(F.col("sex") == "2", F.col("q"))).alias("f"), F.avg(F.when(F.col("sex") == "1", F.col("q"))).alias("m"))
    four = lambda c: F.bround(c, 4)
    return a.join(b, "label").select("label", four(F.col("auto")).alias("mean_auto"), four(F.col("x")).alias("mean_x"), four(F.col("x") - F.col("auto")).alias("delta"), four(F.col("f")).alias("mean_x_female"), four(F.col("m")).alias("mean_x_male"))


def per_sample(auto: DataFrame, x: DataFrame) -> DataFrame:
    """``(sample_id, label, q_auto, q_x, delta)`` of samples in both."""
    a = auto.select("sample_id", "label", F.col("q").alias("q_auto"))
    b = x.select("sample_id", "label", F.col("q").alias("q_x"))
    return a.join(b, ["sample_id", "label"]).withColumn("delta", F.bround(F.col("q_x") - F.col("q_auto"), 6))


def focal(comparison: DataFrame) -> DataFrame:
    """The label with the greatest absolute difference; ties to the first by name."""
    return comparison.orderBy(F.abs("delta").desc(), "label").limit(1)


def cv_summary(runs: DataFrame) -> DataFrame:
    """``(k, mean_cv, sd_cv, best_rep, seconds, best_k)`` from ``runs (k, rep, cv, seconds)``."""
    by_k = runs.groupBy("k").agg(F.avg("cv").alias("mean_cv"), F.stddev_pop("cv").alias("sd_cv"), F.min_by("rep", F.struct("cv", "rep")).alias("best_rep"), F.sum("seconds").alias("seconds"))
    best = by_k.agg(F.min_by("k", F.struct("mean_cv", "k")).alias("least"))
    return by_k.join(F.broadcast(best)).withColumn("best_k", F.col("k") == F.col("least")).drop("least")


def cv_errors(lines: DataFrame) -> DataFrame:
    """``(file, k, cv)``: the last cross-validation error that each log states."""
    hit = F.regexp_extract("line", r"CV error \(K=(\d+)\):\s*([0-9.eE+-]+)", 0)
    rows = lines.select("file", "line_number", "line").where(hit != "")
    last = rows.groupBy("file").agg(F.max_by("line", "line_number").alias("line"))
    at = lambda k: F.regexp_extract("line", r"CV error \(K=(\d+)\):\s*([0-9.eE+-]+)", k)
    return last.select("file", at(1).cast("int").alias("k"), at(2).try_cast("double").alias("cv"))


def admixture_em(d: DataFrame, k: int, rounds: int = 20, seed: int = 7) -> DataFrame:
    """``(sample_id, component, q)``: proportions by expectation-maximisation of the binomial admixture likelihood."""
    q, _ = admixture(d, k, rounds, seed)
    return q.select("sample_id", F.posexplode("q").alias("component", "q"))


#: Bytes of the samples' proportions that are sent to the tasks of a round.
MOST_BYTES = 512 << 20
#: Calls of a block of variants in a round and of a task's rows, and samples whose sums travel together.
CALLS, TASK_CALLS, BLOCK = 1 << 16, 1 << 22, 1 << 16


def admixture(d: DataFrame, k: int, rounds: int = 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Proportions ``(sample_id, q)`` and frequencies ``(rsid, p)``, as arrays of ``k``.

    ``d`` has ``(sample_id, rsid, dosage)`` and may have ``ploidy``, the number of alleles that a dosage counts (1 on a
    male's X, else 2; null is 2).
    """
    return admixtures(d, [F.lit(True)], k, rounds, seed)[0]


def admixtures(d: DataFrame, runs: list[Column], k: int, rounds: int = 20, seed: int = 7) -> list[tuple[DataFrame, DataFrame]]:
    """What ``admixture`` gives for the calls of each of up to 15 ``runs``, conditions on the rows of ``d``, in one go.

    The calls are read and meet by variant once, whatever number of runs they belong to; a round reads a variant's calls
    beside its frequencies, makes its next ones in its own task, and sends only sums for the samples' proportions, which
    are a matrix a run on the driver (``MOST_BYTES`` at most, with an error). Starts are hashes, so runs repeat.
    """
    spark = d.sparkSession
    ploidy = F.coalesce(F.col("ploidy"), F.lit(2)) if "ploidy" in d.columns else F.lit(2)
    cell = "smallint" if isinstance(d.schema["dosage"].dataType, IntegralType) else "double"
    bits = reduce(lambda x, y: x.bitwiseOR(y), (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(runs)))
    # Written as they come: a filter before that would make what dosages are derived from once more.
    d = written(d.select("sample_id", "rsid", "dosage", ploidy.alias("ploidy"), bits.cast("smallint").alias("runs")))
    calls = d.where("dosage is not null and sample_id is not null and rsid is not null and runs > 0")
    calls = calls.select("sample_id", "rsid", F.col("dosage").cast(cell).alias("alt"), (F.col("ploidy") - F.col("dosage")).cast(cell).alias("ref"), "runs")
    comps = F.array(*map(F.lit, range(k)))
    noise = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1000)) / 1000.0
    most = MOST_BYTES // (8 * max(1, k) * len(runs))
    found = calls.groupBy("sample_id").agg(F.bit_or("runs").alias("runs"), F.count("*").alias("calls"))
    found = found.withColumn("q", F.transform(comps, lambda c: 0.5 + noise(F.col("sample_id"), c))).orderBy("sample_id").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} samples for {k} components in {len(runs)} runs")
    names = [r.sample_id for r in found]
    q = np.array([r.q for r in found]).reshape(len(names), k)
    q = np.stack([q / q.sum(1, keepdims=True)] * len(runs))
    kind = d.schema["sample_id"].dataType.simpleString()
    places = F.broadcast(spark.createDataFrame([(s, n) for n, s in enumerate(names)], f"sample_id {kind}, at int"))
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(r.calls for r in found) // TASK_CALLS))

    def start(i: int) -> Column:
        mine = F.col("runs").bitwiseAND(F.lit(1 << i)) != 0
        total = lambda c: F.sum(F.when(mine, c).cast("double"))
        m = total(F.col("alt")) / F.nullif(total(F.col("alt") + F.col("ref")), F.lit(0.0))
        near = F.transform(comps, lambda c: F.greatest(F.lit(0.02), F.least(F.lit(0.98), m + 0.2 * (noise(F.col("rsid"), c) - 0.5))))
        return F.when(F.count_if(mine) > 0, near).otherwise(F.array_repeat(F.lit(float("nan")), k))  # no part of the run

    rows = calls.join(places, "sample_id").repartition(parts, "rsid").groupBy("rsid")
    calls = written(rows.agg(F.concat(*map(start, range(len(runs)))).alias("p"), *(F.collect_list(c).alias(c) for c in ("at", "alt", "ref", "runs"))))
    discard(d)
    for n in range(rounds if names else 0):
        before = calls
        with by_files(spark, 8 * CALLS // len(names)):
            calls, q = one_round(before, q, last=n == rounds - 1)
        discard(before)
    schema = f"sample_id {kind}, q array<double>"
    out = []
    for i in range(len(runs)):
        own = [(r.sample_id, x) for r, x in zip(found, q[i].tolist(), strict=True) if r.runs >> i & 1]
        p = calls.select("rsid", F.slice("p", i * k + 1, k).alias("p")).where(~F.isnan(F.get("p", F.lit(0))))
        out.append((spark.createDataFrame(own, schema), p))
    return out


def one_round(calls: DataFrame, q: np.ndarray, last: bool) -> tuple[DataFrame, np.ndarray]:
    """A round over ``calls (rsid, p, at, alt, ref, runs)``: the same with the next frequencies, and the next proportions.

    ``q`` is runs by samples by components, ``p`` the frequencies of all runs. After the ``last`` the calls aren't written
    again, only frequencies.
    """
    shared = calls.sparkSession.sparkContext.broadcast(q)
    g, n, k = q.shape
    cells = ["at", "alt", "ref", "runs"]
    kinds = [calls.schema[c].dataType for c in ("rsid", *cells)]
    schema = ", ".join([f"rsid {kinds[0].simpleString()}, p array<double>", *(f"{c} {t.simpleString()}" for c, t in zip(cells, kinds[1:], strict=True)), "run int, block int, cells binary"])
    names = [c.split()[0] for c in schema.split(", ")]
    pa_kinds = [to_arrow_type(t) for t in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, sums = shared.value, np.zeros((g, n, k))
        for batch in batches:
            lengths = pc.list_value_length(batch["at"]).to_numpy()
            ends, p = np.cumsum(lengths, dtype=np.int64), np.asarray(batch["p"].flatten()).reshape(-1, g * k)
            flat = [np.asarray(batch[c].flatten()) for c in cells]
            after, first = np.empty_like(p), 0
            while first < len(p):  # a block of variants of ``CALLS`` calls, or a single one
                begin = ends[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(ends, begin + CALLS, "right")))
                at, alt, ref, runs = (c[begin : ends[end - 1]] for c in flat)
                of = np.repeat(np.arange(end - first), lengths[first:end])
                for i in range(g):
                    mine = np.flatnonzero(runs >> i & 1)
                    those = (at, alt, ref, of) if len(mine) == len(of) else (c[mine] for c in (at, alt, ref, of))
                    theirs = p[first:end, i * k : (i + 1) * k]
                    after[first:end, i * k : (i + 1) * k] = np.where(np.isnan(theirs), theirs, expectation(*those, q[i], theirs, sums[i]))
                first = end
            after = pa.array(list(after), pa.list_(pa.float64()))
            kept = [pa.nulls(len(p), batch[c].type) if last else batch[c] for c in cells]
            yield pa.RecordBatch.from_arrays([batch["rsid"], after, *kept, pa.nulls(len(p), pa.int32()), pa.nulls(len(p), pa.int32()), pa.nulls(len(p), pa.binary())], names)
        blocks = [(i, b) for i in range(g) for b in range(-(-n // BLOCK))]
        none = [pa.nulls(len(blocks), t) for t in (pa_kinds[0], pa.list_(pa.float64()), *pa_kinds[1:])]
        totals = [sums[i, b * BLOCK : (b + 1) * BLOCK].tobytes() for i, b in blocks]
        yield pa.RecordBatch.from_arrays([*none, pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.int32()), pa.array(totals, pa.binary())], names)

    after = written(calls.mapInArrow(run, schema))
    own = np.zeros((g, n, k))
    for r in added_up(after.where("block is not null").select("run", "block", "cells"), ["run", "block"]).collect():  # as large as the proportions
        own[r.run, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.cells).reshape(-1, k)
    shared.unpersist()
    return after.where("block is null").select("rsid", "p", *cells), own / np.maximum(own.sum(2, keepdims=True), 1e-300)


def expectation(at: np.ndarray, alt: np.ndarray, ref: np.ndarray, of: np.ndarray, q: np.ndarray, p: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The next frequencies of a block of variants ``p`` whose calls are of samples ``at`` and of rows ``of``; adds to the samples' ``sums``."""
    n, k = q.shape
    ups = q[at] * p[of]
    downs = q[at] - ups
    ups *= (alt / ups.sum(1))[:, None]
    downs *= (ref / downs.sum(1))[:, None]
    a, r = (np.stack([np.bincount(of, x[:, c], len(p)) for c in range(k)], 1) for x in (ups, downs))
    ups += downs
    for c in range(k):
        sums[:, c] += np.bincount(at, ups[:, c], n)
    with np.errstate(invalid="ignore"):
        return np.clip(np.nan_to_num(a / (a + r), nan=1.0), 1e-6, 1 - 1e-6)  # nothing of a component is left at the variant


def haploid_males(d: DataFrame, sexes: DataFrame) -> DataFrame:
    """``d`` with ``ploidy``, and the dosages of males on the X as counts of one allele; heterozygous ones there are missing.

    ``sexes`` is ``(sample_id, sex)`` with 1 or M for males. A sample without a sex counts as diploid.
    """
    male = F.coalesce((F.col("chrom") == "X") & F.col("sex").isin("1", "M"), F.lit(False))
    rows = d.join(sexes.select("sample_id", "sex").distinct(), "sample_id", "left")
    dosage = F.when(~male, F.col("dosage")).when(F.col("dosage") != 1, (F.col("dosage") / 2).cast("int"))
    return rows.withColumns({"dosage": dosage, "ploidy": F.when(male, 1).otherwise(2)}).drop("sex")


def cross_validated(d: DataFrame, ks: list[int], folds: int = 5, rounds: int | None = None, seed: int = 7, tolerance: float = 1e-4) -> DataFrame:
    """``(k, rep, cv, seconds)``, a row a number of components and fold, as ``cv_summary`` takes them; ``seconds`` is a model's
    share of the time, as all of them are fitted in one run.

    A fold's calls are chosen by a hash of sample and variant and left out of the fit; ``cv`` is the mean deviance of
    their dosages under the fitted frequencies. A fit goes on until a cycle of three rounds raises its likelihood by less
    than ``tolerance``, unless ``rounds`` ends it before.
    """
    models = [admix.Model(k, seed + k, fold) for k in ks for fold in range(folds)]
    fits = admix.fit(d, models, folds, tolerance, rounds, seed=seed, relax=True)
    return fits.runs.select("k", F.col("fold").cast("long").alias("rep"), "cv", F.lit(int(fits.seconds / max(1, len(models)))).cast("long").alias("seconds"))


def headline_and_females(d: DataFrame, sexes: DataFrame, k: int, rounds: int | None = None, seed: int = 7, tolerance: float = 1e-4) -> DataFrame:
    """``(run, sample_id, component, q)``: all samples on autosomes, and females alone on autosomes and on the X.

    For software without haploid calls: the X is only compared among those with two of them. ``sexes`` is ``(sample_id,
    sex)`` with 2 or F for females. The three fits go through the calls together, until a cycle of three rounds of
    ``admix.fit`` raises each one's likelihood by less than ``tolerance``; ``rounds`` asks for so many of ``admixture`` instead.
    """
    females = sexes.where(F.col("sex").isin("2", "F")).select("sample_id", F.lit(True).alias("female")).distinct()
    d = d.drop("female").join(F.broadcast(females), "sample_id", "left")  # no more than the samples, which go to all tasks anyway
    auto, female = F.col("chrom") != "X", F.coalesce("female", F.lit(False))
    runs = {"headline_auto": auto, "female_auto": auto & female, "female_x": (F.col("chrom") == "X") & female}
    if rounds is None:
        bits = reduce(lambda x, y: x.bitwiseOR(y), (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(runs.values())))
        models = [admix.Model(k, seed + k, part=i) for i in range(len(runs))]
        called = d.where("sample_id is not null and rsid is not null").withColumn("parts", bits.cast("smallint"))
        q = admix.fit(called, models, 0, tolerance, None, relax=True).q
        return q.select(F.get(F.array(*map(F.lit, runs)), F.col("model")).alias("run"), "sample_id", "component", "q")
    parts = [q.select(F.lit(name).alias("run"), "sample_id", F.posexplode("q").alias("component", "q")) for name, (q, _) in zip(runs, admixtures(d, list(runs.values()), k, rounds, seed + k), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
