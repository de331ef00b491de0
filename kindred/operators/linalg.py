"""Principal components by Gram matrices over samples, projections, and clusterings of few populations.

What is large is the number of variants: sums over them are Spark aggregations. What reaches the driver is a matrix of
samples by samples (or populations), whose size is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of the symmetric matrix that the driver may hold: 8 bytes a cell, 200 MB.
MOST_SAMPLES = 5000


def centred(d: DataFrame) -> DataFrame:
    """``(sample_id, rsid, x)``: dosages less their variant's mean; a missing one counts as the mean, so its row goes."""
    d = written(d.select("sample_id", "rsid", "dosage"))
    means = d.groupBy("rsid").agg(F.avg("dosage").alias("mean"))
    return d.where("dosage is not null").join(means, "rsid").select("sample_id", "rsid", (F.col("dosage") - F.col("mean")).alias("x"))


def standardised(d: DataFrame) -> DataFrame:
    """As ``centred``, over the square root of 2p(1 - p); variants without variation go."""
    d = written(d.select("sample_id", "rsid", "dosage"))
    means = d.groupBy("rsid").agg(F.avg("dosage").alias("mean")).withColumn("p", F.col("mean") / 2)
    means = means.where("p > 0 and p < 1")
    return d.where("dosage is not null").join(means, "rsid").select("sample_id", "rsid", ((F.col("dosage") - F.col("mean")) / F.sqrt(2 * F.col("p") * (1 - F.col("p")))).alias("x"))


def unit_rows(d: DataFrame) -> DataFrame:
    """Dosages less their variant's mean over its standard deviation, missing ones as the mean."""
    d = written(d.select("sample_id", "rsid", "dosage"))
    stats = d.groupBy("rsid").agg(F.avg("dosage").alias("mean"), F.stddev_pop("dosage").alias("sd")).where("sd > 0")
    return d.where("dosage is not null").join(stats, "rsid").select("sample_id", "rsid", ((F.col("dosage") - F.col("mean")) / F.col("sd")).alias("x"))


#: Rows and columns of a tile in which matrices travel.
TILE = 512


def tiles(x: DataFrame) -> tuple[list, DataFrame]:
    """Names in order, and ``(ti, tj, cells)`` for ti <= tj: square tiles of the matrix of sums over variants of x_i * x_j.

    A variant's samples meet as arrays of places and values, and each partition adds up its own matrix in numpy, so what
    is shuffled is a matrix of numbers a partition, not a row a pair.
    """
    names = [r[0] for r in x.select("sample_id").distinct().orderBy("sample_id").limit(MOST_SAMPLES + 1).collect()]
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"over {MOST_SAMPLES} samples; project on loadings instead")
    kind = x.schema["sample_id"].dataType.simpleString()
    places = F.broadcast(x.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], f"sample_id {kind}, k int"))
    rows = x.join(places, "sample_id").groupBy("rsid").agg(F.collect_list("k").alias("k"), F.collect_list("x").alias("x")).select("k", "x")
    cuts = range(0, len(names), TILE)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)))
        for b in batches:
            for at in range(0, len(b), 1024):  # a dense block of at most 1024 variants
                part = b.iloc[at : at + 1024]
                dense = np.zeros((len(part), len(names)))
                dense[np.repeat(np.arange(len(part)), part["k"].map(len)), np.concatenate(part["k"].to_list())] = np.concatenate(part["x"].to_list())
                total += dense.T @ dense
        made = [(i // TILE, j // TILE, total[i : i + TILE, j : j + TILE].tobytes()) for i in cuts for j in cuts if i <= j]
        yield pd.DataFrame(made, columns=["ti", "tj", "cells"])

    return names, added_up(rows.mapInPandas(add, "ti int, tj int, cells binary"), ["ti", "tj"])


#: Partitions whose parts of a sum meet in one task at first.
FAN_IN = 32


def added_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, cells)``: sums by key of arrays of float64, as bytes; parts of up to ``FAN_IN`` partitions first, then their sums."""
    schema = ", ".join([*(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys), "cells binary"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(pdf["cells"].iloc[0]).copy()
        for c in pdf["cells"].iloc[1:]:
            cells += np.frombuffer(c)
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "cells": [cells.tobytes()]})

    some = parts.withColumn("share", F.floor(F.spark_partition_id() / FAN_IN)).groupBy(*keys, "share").applyInPandas(total, schema)
    return some.groupBy(*keys).applyInPandas(total, schema)


def gram(x: DataFrame) -> DataFrame:
    """``(i, j, g)`` for i <= j: sums over variants of x_i * x_j."""
    names, found = tiles(x)
    kind = x.schema["sample_id"].dataType.simpleString()

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ti, tj, data in zip(b["ti"], b["tj"], b["cells"], strict=True):
                left, right = names[ti * TILE : (ti + 1) * TILE], names[tj * TILE : (tj + 1) * TILE]
                m = np.frombuffer(data).reshape(len(left), len(right))
                i, j = np.triu_indices(len(left)) if ti == tj else np.indices(m.shape).reshape(2, -1)
                yield pd.DataFrame({"i": [left[k] for k in i], "j": [right[k] for k in j], "g": m[i, j]})

    return found.mapInPandas(cells, f"i {kind}, j {kind}, g double")


def gram_sql(x: DataFrame) -> DataFrame:
    """The same by a join of variants with themselves: for few samples."""
    other = x.select("rsid", F.col("sample_id").alias("j"), F.col("x").alias("y"))
    return x.join(other, "rsid").where("sample_id <= j").groupBy(F.col("sample_id").alias("i"), "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def eigen(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, and eigenvectors whose greatest entry is positive."""
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return np.maximum(values, 0), vectors * np.where(sign == 0, 1, sign)


def pca(x: DataFrame, k: int = 5, of_emitted: bool = False) -> DataFrame:
    """``(sample_id, pc, score, variance, explained)`` from rows ``x (sample_id, rsid, x)``.

    ``explained`` is a component's share of all variance or, ``of_emitted``, of that of the ``k`` given. The matrix of
    samples by samples (at most ``MOST_SAMPLES`` squared) is made once, and its tiles reach the driver; ``randomised_pca``
    makes none.
    """
    names, found = tiles(x)
    m = np.zeros((len(names), len(names)))
    for r in found.toLocalIterator():
        i, j = r.ti * TILE, r.tj * TILE
        part = np.frombuffer(r.cells).reshape(min(TILE, len(names) - i), -1)
        m[i : i + part.shape[0], j : j + part.shape[1]] = part
        m[j : j + part.shape[1], i : i + part.shape[0]] = part.T
    values, vectors = eigen(m, k)
    total = float(values.sum() if of_emitted else np.trace(m))
    return component_rows(x, names, values, vectors, total)


def component_rows(x: DataFrame, names: list, values: np.ndarray, vectors: np.ndarray, total: float) -> DataFrame:
    scores = vectors * np.sqrt(values)
    rows = [
        (s, c + 1, float(scores[n, c]), float(values[c]) / max(1, len(names) - 1), float(values[c]) / total if total else 0.0) for n, s in enumerate(names) for c in range(len(values))
    ]
    kind = x.schema["sample_id"].dataType.simpleString()
    return x.sparkSession.createDataFrame(rows, f"sample_id {kind}, pc int, score double, variance double, explained double")


#: Samples times columns of the blocks that randomised components send to tasks and driver: 512 MB.
MOST_CELLS = 1 << 26
#: Rows of a block of samples that is added up as one.
BLOCK = 1 << 16


def randomised_pca(x: DataFrame, k: int = 10, oversample: int = 10, most_rounds: int = 30, tolerance: float = 1e-10, seed: int = 7) -> DataFrame:
    """As ``pca``, for many samples: a subspace of ``k + oversample`` columns, iterated, and no matrix of samples by samples.

    A round multiplies the subspace's block Q (samples by columns) by X X', variant by variant in its task, and
    orthonormalises it; that is a power iteration of the range finder. The components are those of Q' X X' Q. Rounds end
    when no eigenvalue of the first ``k`` rises by more than its ``tolerance``-th part. Starts are drawn from ``seed``. If
    there are no more samples than columns, the first round is exact. ``explained`` is the share of all variance. Blocks
    are bounded by ``MOST_CELLS``, with an error. Samples without a row have no score.
    """
    spark = x.sparkSession
    most = MOST_CELLS // (k + oversample)
    names = [r[0] for r in x.select("sample_id").distinct().orderBy("sample_id").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} samples")
    n = len(names)
    kind = x.schema["sample_id"].dataType.simpleString()
    places = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(names)], f"sample_id {kind}, at int"))
    rows = x.join(places, "sample_id").groupBy("rsid").agg(F.collect_list("at").alias("at"), F.collect_list("x").alias("x"))
    rows = written(rows.select("at", "x"))
    whole = rows.select(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0] or 0.0
    width = min(n, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0] if n else np.zeros((0, 0))
    values, vectors = np.zeros(width), q
    for _ in range(most_rounds if n else 0):
        product = multiplied(rows, q)
        small = q.T @ product
        found, turn = np.linalg.eigh((small + small.T) / 2)
        found, vectors = found[::-1], q @ turn[:, ::-1]
        done = width == n or np.all(np.abs(found[:k] - values[:k]) <= tolerance * np.maximum(np.abs(found[:k]), 1e-300))
        values = found
        if done:
            break
        q = np.linalg.qr(product)[0]
    values, vectors = np.maximum(values[:k], 0), vectors[:, :k]
    if n:
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        vectors = vectors * np.where(sign == 0, 1, sign)
    return component_rows(x, names, values, vectors, whole)


def multiplied(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X X' times a block of columns, X' being the variants' ``rows (at, x)``: each partition's sum, then their sums."""
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        total, some = np.zeros_like(q), False
        for b in batches:
            for first in range(0, len(b), 4096):
                part = b.iloc[first : first + 4096]
                at, v = np.concatenate(part["at"].to_list()), np.concatenate(part["x"].to_list())
                ends = np.cumsum(part["at"].map(len).to_numpy())
                of = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
                for c in range(q.shape[1]):
                    y = np.bincount(of, v * q[at, c], len(part))
                    total[:, c] += np.bincount(at, v * y[of], len(q))
                some = True
        if some:
            yield pd.DataFrame({"block": range(-(-len(q) // BLOCK)), "cells": [total[i : i + BLOCK].tobytes() for i in range(0, len(q), BLOCK)]})

    out = np.zeros_like(q)
    for r in added_up(rows.mapInPandas(run, "block int, cells binary"), ["block"]).toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.cells).reshape(-1, q.shape[1])
    shared.unpersist()
    return out


def population_rows(af: DataFrame, across: str = "pop") -> DataFrame:
    """Frequencies standardised within each population (``across`` "pop"), or centred by locus ("locus_key")."""
    stats = af.groupBy(across).agg(F.avg("allele_freq").alias("mean"), F.stddev_pop("allele_freq").alias("sd"))
    x = (F.col("allele_freq") - F.col("mean")) / (F.nullif(F.col("sd"), F.lit(0.0)) if across == "pop" else F.lit(1.0))
    return af.join(stats, across).select(F.col("pop").alias("sample_id"), F.col("locus_key").alias("rsid"), x.alias("x")).where("x is not null")


def project(d: DataFrame, loadings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``(sample_id, pc, score)``: dosages projected on ``loadings (rsid, loadings, pca_af)``.

    A sample's score sums (dosage - 2p) * loading / sqrt(M * 2p(1 - p)), M being all variants of the loadings; what is
    missing counts as the mean, that is nothing. Variants with p of 0 or 1 are no part of the sum, but of M.
    """
    key = key or ["rsid"]
    loadings = written(loadings)
    m = loadings.count()
    used = loadings.where("pca_af > 0 and pca_af < 1")
    used = used.select(*key, "pca_af", F.transform("loadings", lambda v: v / F.nullif(F.sqrt(F.lit(float(m)) * 2 * F.col("pca_af") * (1 - F.col("pca_af"))), F.lit(0.0))).alias("w"))
    rows = d.where("dosage is not null").join(used, key).select("sample_id", (F.col("dosage") - 2 * F.col("pca_af")).alias("x"), F.posexplode("w").alias("k", "w"))
    return rows.groupBy("sample_id", (F.col("k") + 1).alias("pc")).agg(F.sum(F.col("x") * F.col("w")).alias("score"))


def explained(values: DataFrame) -> DataFrame:
    """``percent`` of the total for each eigenvalue."""
    total = values.agg(F.sum("value").alias("total"))
    return values.join(F.broadcast(total)).select("pc", "value", (100 * F.col("value") / F.nullif(F.col("total"), F.lit(0.0))).alias("percent"))


def centroids(scores: DataFrame, labels: DataFrame, pcs: int) -> DataFrame:
    """``(region, population, n_ref, centroid)`` of labelled samples; scores are ``(sample_id, pcs array)``."""
    mean = F.array(*(F.avg(F.get("pcs", F.lit(k))) for k in range(pcs)))
    return scores.join(labels, "sample_id").groupBy("region", "population").agg(F.count("*").alias("n_ref"), mean.alias("centroid"))


def closest(study: DataFrame, centres: DataFrame, top: int = 5, tie: float = 1.15) -> DataFrame:
    """``(sample_id, rank, region, population, label, n_ref, distance, close)``: the nearest centroids of each sample.

    ``close`` holds within ``tie`` of the least distance. Centroids are as few as populations; they are one array beside
    each sample, so a sample's ranking needs no shuffle.
    """
    every = centres.agg(F.array_sort(F.collect_list(F.struct("region", "population", "n_ref", "centroid"))).alias("centres"))

    def distance(c: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with("pcs", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))

    near = F.transform("centres", lambda c: F.struct(distance(c["centroid"]).alias("distance"), c["region"].alias("region"), c["population"].alias("population"), c["n_ref"].alias("n_ref")))
    rows = study.join(F.broadcast(every)).select("sample_id", F.array_sort(near).alias("near"))
    best = F.get("near", F.lit(0))["distance"]
    rows = rows.select("sample_id", best.alias("best"), F.posexplode(F.slice("near", 1, top)).alias("k", "x"))
    cut = F.when(F.col("best") > 0, F.col("best") * tie).otherwise(F.lit(5e-324))
    return rows.select("sample_id", (F.col("k") + 1).alias("rank"), "x.region", "x.population", F.concat(F.lit("["), "x.region", F.lit("] "), "x.population").alias("label"), "x.n_ref", "x.distance", (F.col("x.distance") <= cut).alias("close"))


def upgma(names: list[str], distance: np.ndarray) -> list[tuple[str, str, float, int]]:
    """Merges ``(left, right, height, size)`` of average linkage over a small matrix, ties in order of name."""
    clusters = {n: [k] for k, n in enumerate(names)}
    d = np.maximum(np.asarray(distance, float), 0)
    out = []
    while len(clusters) > 1:
        keys = sorted(clusters)
        pairs = [(float(d[np.ix_(clusters[a], clusters[b])].mean()), a, b) for n, a in enumerate(keys) for b in keys[n + 1 :]]
        height, a, b = min(pairs)
        members = clusters.pop(a) + clusters.pop(b)
        clusters[f"({a},{b})"] = members
        out.append((a, b, height, len(members)))
    return out


#: Rows that are put in order on the driver; a heat map shows a few dozen.
MOST_ROWS = 2000


def row_order(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, nth)``: the order of the leaves when rows are joined by average linkage of their Euclidean distances."""
    found = rows.select(key, *columns).orderBy(key).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows")
    x = np.array([[float(r[c]) for c in columns] for r in found]).reshape(len(found), len(columns))
    names = [str(k) for k in range(len(found))]
    leaves = {n: [k] for k, n in enumerate(names)}
    distance = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for left, right, _, _ in upgma(names, distance):
        leaves[f"({left},{right})"] = leaves.pop(left) + leaves.pop(right)
    order = next(iter(leaves.values()), [])
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(found[k][key], n + 1) for n, k in enumerate(order)], f"{key} {kind}, nth int")


def population_tree(fst: DataFrame) -> DataFrame:
    """``(left, right, height, size)``: average linkage of populations by their fixation indices."""
    rows = fst.collect()  # a row a pair of populations
    names = sorted({r.pop1 for r in rows} | {r.pop2 for r in rows})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        a, b = names.index(r.pop1), names.index(r.pop2)
        m[a, b] = m[b, a] = max(0.0, r.fst or 0.0)
    return fst.sparkSession.createDataFrame(upgma(names, m), "left string, right string, height double, size int")
