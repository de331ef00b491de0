"""Linkage between variants near each other, and greedy pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT
from ..sources.shared import written
from .ordinals import numbered


def ordered(d: DataFrame) -> DataFrame:
    """``(chrom, pos, rsid, ord)`` of each variant, numbered along its chromosome."""
    return numbered(d.select("chrom", "pos", "rsid").distinct(), ["chrom", "pos", "rsid"], within=["chrom"])


#: Samples whose numbers are broadcast at most.
MOST_SAMPLES = 1_000_000


def stretches(d: DataFrame, window: int, places: DataFrame) -> tuple[int, DataFrame]:
    """How many places a stretch has, and ``(chrom, cell, ord, rsid, planes)``.

    A variant travels as bits, three a sample (see ``planes``), to its stretch of places, and those near a stretch's end to
    the next as well. ``places`` is ``ordered(d)``.
    """
    length = 4 * window
    samples = numbered(d.select("sample_id").distinct(), ["sample_id"], "k").withColumn("k", F.col("k") - 1)
    n = samples.count()
    called = d.where("dosage is not null").join(F.broadcast(samples) if n <= MOST_SAMPLES else samples, "sample_id")
    rows = called.groupBy("chrom", "pos", "rsid").agg(F.collect_list("k").alias("k"), F.collect_list("dosage").alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["chrom", "pos", "rsid"]].assign(planes=[planes(np.asarray(k), np.asarray(v), n) for k, v in zip(b["k"], b["v"], strict=True)])

    rows = rows.mapInPandas(pack, "chrom string, pos long, rsid string, planes binary")
    rows = rows.join(places, ["chrom", "pos", "rsid"]).withColumn("cell", F.floor(F.col("ord") / length))
    late = F.col("ord") % length >= length - window
    return length, rows.select("chrom", "ord", "rsid", "planes", F.explode(F.when(late, F.array("cell", F.col("cell") + 1)).otherwise(F.array("cell"))).alias("cell"))


def planes(k: np.ndarray, v: np.ndarray, n: int) -> bytes:
    """Of ``n`` samples, which are called, which have one alternate allele, and which two: bits in words of 64."""
    bits = np.zeros((3, -(-max(n, 1) // 64) * 64), bool)
    bits[0, k], bits[1, k], bits[2, k] = True, v == 1, v == 2
    return np.packbits(bits, axis=1).tobytes()


def counted(*words: np.ndarray) -> np.ndarray:
    """How many bits are set in all of ``words``, row by row."""
    both = words[0]
    for w in words[1:]:
        both = both & w
    return np.bitwise_count(both).sum(1, dtype=np.int64)


def pair_sums(pdf: pd.DataFrame, length: int, window: int) -> tuple[np.ndarray, ...]:
    """Of rows in order of place: the pairs ``a`` before ``b`` that are at most ``window`` places apart, with b at home.

    With them, over the samples that have both calls: how many there are, and the sums of x, y, xx, yy and xy; all by
    counting bits, a shift of the rows at a time.
    """
    place = pdf["ord"].to_numpy(np.int64)
    home = place // length == int(pdf["cell"].iloc[0])
    words = np.frombuffer(b"".join(pdf["planes"]), np.uint64).reshape(len(pdf), 3, -1)
    out = []
    for shift in range(1, min(window, len(pdf) - 1) + 1):
        a = np.flatnonzero((place[shift:] - place[:-shift] <= window) & home[shift:])
        if not len(a):
            continue
        (ca, a1, a2), (cb, b1, b2) = words[a].transpose(1, 0, 2), words[a + shift].transpose(1, 0, 2)
        x1, x2, y1, y2 = counted(a1, cb), counted(a2, cb), counted(ca, b1), counted(ca, b2)
        xy = counted(a1, b1) + 2 * (counted(a1, b2) + counted(a2, b1)) + 4 * counted(a2, b2)
        out.append((a, a + shift, counted(ca, cb), x1 + 2 * x2, y1 + 2 * y2, x1 + 4 * x2, y1 + 4 * y2, xy))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 8


def pairwise_r2(d: DataFrame, window: int = DEFAULT.ld_window) -> DataFrame:
    """``(chrom, a, b, n, r2)`` of variants at most ``window`` places apart, over samples with both calls.

    Sums are counts of bits, in each stretch of places by itself (see ``stretches``), and divided once at the end. Pairs
    without a sample in common are left out; r2 is null where one doesn't vary.
    """
    length, rows = stretches(d, window, ordered(d))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        found = pair_sums(pdf, length, window)
        a, b, n, sx, sy, sxx, syy, sxy = (x[found[2] > 0] for x in found)
        m, sx, sy, sxx, syy, sxy = (x.astype(float) for x in (n, sx, sy, sxx, syy, sxy))
        cov, var = m * sxy - sx * sy, (m * sxx - sx * sx) * (m * syy - sy * sy)
        r2 = pd.array(np.where(var > 0, cov * cov / np.where(var > 0, var, 1), np.nan), "Float64", copy=True)
        names = pdf["rsid"].to_numpy()
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "a": names[a], "b": names[b], "n": n, "r2": r2})

    found = rows.groupBy("chrom", "cell").applyInPandas(compare, "chrom string, a string, b string, n long, r2 double")
    return found.withColumn("r2", F.nanvl("r2", F.lit(None).cast("double")))


def links(d: DataFrame, window: int = DEFAULT.ld_window, most: float = DEFAULT.ld_r2, places: DataFrame | None = None) -> DataFrame:
    """``(chrom, a, b)``: places of variants at most ``window`` apart, a before b, whose r2 is above ``most``.

    Missing dosages count as their variant's mean: such a sample adds nothing to sums of what is above or below the mean.
    A task holds a few windows of variants (see ``stretches``), whatever the chromosome's length, and gives only the links.
    """
    length, rows = stretches(d, window, ordered(d) if places is None else places)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        place = pdf["ord"].to_numpy(np.int64)
        words = np.frombuffer(b"".join(pdf["planes"]), np.uint64).reshape(len(pdf), 3, -1)
        n, one, two = (counted(words[:, k]).astype(float) for k in range(3))
        mean = (one + 2 * two) / np.maximum(n, 1)
        spread = one + 4 * two - n * mean * mean
        a, b, m, sx, sy, _, _, sxy = pair_sums(pdf, length, window)
        cov = sxy - mean[a] * sy - mean[b] * sx + m * mean[a] * mean[b]
        var = spread[a] * spread[b]
        near = (var > 1e-12) & (cov * cov > most * var)
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "a": place[a[near]], "b": place[b[near]]})

    return rows.groupBy("chrom", "cell").applyInPandas(compare, "chrom string, a long, b long")


#: Places of a chromosome that a running maximum or sum goes through in one task.
BLOCK = 100_000


def running(rows: DataFrame, value: str, name: str, of: str) -> DataFrame:
    """``rows (chrom, ord, ...)`` with ``name``: the ``of`` (max or sum) of ``value`` over all places before on the chromosome; null for the first.

    Blocks of places first give one number each, and those of the blocks before are the start within a block.
    """
    add = {"max": F.max, "sum": F.sum}[of]
    rows = rows.withColumn("_block", F.floor(F.col("ord") / BLOCK))
    blocks = rows.groupBy("chrom", "_block").agg(add(value).alias("_own"))
    before = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("chrom", "_block", add("_own").over(before).alias("_start"))
    inside = add(value).over(Window.partitionBy("chrom", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.join(blocks, ["chrom", "_block"])
    both = F.greatest("_start", inside) if of == "max" else F.when(F.col("_start").isNotNull() | inside.isNotNull(), F.coalesce("_start", F.lit(0)) + F.coalesce(inside, F.lit(0)))
    return joined.withColumn(name, both).drop("_block", "_start")


def prune(d: DataFrame, window: int = DEFAULT.ld_window, most: float = DEFAULT.ld_r2) -> DataFrame:
    """``(chrom, pos, rsid)`` that stay: each is kept unless a kept one at most ``window`` places before has r2 above ``most``.

    Links are found in parallel (see ``links``). The greedy pass walks over them alone, and places that no link spans
    cut a chromosome into clusters that are walked each by itself.
    """
    places = written(ordered(d))
    found = written(links(d, window, most, places))
    far = found.groupBy("chrom", F.col("a").alias("ord")).agg(F.max("b").alias("far")).unionByName(found.select("chrom", F.col("b").alias("ord"), F.col("b").alias("far")))
    far = far.groupBy("chrom", "ord").agg(F.max("far").alias("far"))
    starts = running(far, "far", "before", "max").withColumn("new", F.coalesce(F.col("before") < F.col("ord"), F.lit(True)).cast("int"))
    cluster = running(written(starts.select("chrom", "ord", "new")), "new", "earlier", "sum")
    cluster = cluster.select("chrom", F.col("ord").alias("b"), (F.coalesce("earlier", F.lit(0)) + F.col("new")).alias("cluster"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        for a, b in sorted(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True), key=lambda e: (e[1], e[0])):
            if a not in gone:  # all links to a were seen before
                gone.add(b)
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "ord": sorted(gone)}).astype({"ord": "int64"})

    dropped = found.join(cluster, ["chrom", "b"]).groupBy("chrom", "cluster").applyInPandas(walk, "chrom string, ord long")
    return places.join(dropped, ["chrom", "ord"], "left_anti").select("chrom", "pos", "rsid")
