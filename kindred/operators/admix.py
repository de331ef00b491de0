"""Admixture models to convergence, any number of them in one run.

A call of a sample i at a variant j has alternate alleles with the chance sum_c q_ic p_jc. All models (numbers of
components, folds that are left out, starts) go through the calls together: a round is one job, however many models there
are. A variant is one row, its calls as two strings of bytes (alternate and reference alleles, both 0 where missing) and
beside them each model's frequencies, so a block of variants is matrix products; what leaves a task is the variants' next
frequencies and sums for the samples' proportions, which are a matrix of samples by components on the driver.

Expectation-maximisation is accelerated by squared extrapolation, a secant method: after two rounds x0, x1, x2 the third
begins at x0 - 2 a r + a^2 v with r = x1 - x0, v = (x2 - x1) - r and a = -|r| / |v|. If the likelihood there is less than
at x1, the model goes on from x2. So the likelihood of what is kept never falls.

Where models have to converge, a round is a step of block relaxation instead, which needs about a tenth of the rounds: with
the proportions fixed, each variant's frequencies go to the best of the likelihood's second-order model within their bounds;
then with these the samples' proportions do so within theirs, from gradients and curvatures that are added up. Both steps d
are shortened to d / (1 + |d|), |d| in the metric of the curvature. The likelihood is a sum of logarithms with weights of at
least 1, which is self-concordant, so such a step never lowers it, however far the model's best is.
"""

from __future__ import annotations

import itertools
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import by_files, discard, written
from .linalg import added_up

#: Bytes of all models' proportions that are sent to the tasks.
MOST_BYTES = 512 << 20
#: Cells of a dense block of calls (which stays in a core's cache), those that a worker is given at a time, calls of a
#: task's rows, and samples whose sums travel together.
CELLS, GIVEN, TASK_CALLS, BLOCK = 1 << 15, 1 << 21, 1 << 22, 1 << 16
LEAST = 1e-6
#: Factors, each ``LEAST`` at least, whose product is a number that is still told from 0.
MOST_FACTORS = 48
#: How far apart components' frequencies of a variant start: far enough that few rounds tell them from each other.
SPREAD = 0.8
#: Passes over the coordinates of a second-order model, and what its curvature has at least.
SWEEPS, RIDGE = 10, 1e-9
#: Bytes of sums of all tasks that the driver adds up by itself.
FEW_BYTES = 32 << 20


@dataclass
class Model:
    """A number of components, a start, and the fold of calls that the fit leaves out or the part (a bit) that it is of, if any."""

    k: int
    seed: int = 7
    fold: int | None = None
    part: int | None = None


@dataclass
class State:
    """Where a model is: proportions before, after one and after two rounds, and the likelihoods of the first two."""

    q: list[np.ndarray]
    likelihood: list[float] = field(default_factory=list)  # of what was kept
    rounds: int = 0
    step: float = 1.0
    done: bool = False
    accepted: bool = True
    inner: list[float] = field(default_factory=list)
    final: tuple[int, int] = (0, 0)


@dataclass
class Fits:
    """``runs (model, k, fold, rounds, likelihood, converged, cv)``, ``trace (model, round, likelihood)``, ``q (model, sample_id,
    component, q)`` and ``p (model, rsid, p)``, p an array of k; ``model`` is a model's place in the list."""

    runs: DataFrame
    trace: DataFrame
    q: DataFrame
    p: DataFrame
    jobs: int
    seconds: float


def uniform(name: str, seed: int, k: int) -> np.ndarray:
    """``k`` numbers from 0 to 1 that a name and a seed decide."""
    return np.random.default_rng([zlib.crc32(name.encode()), seed]).random(k)


def bounded(p: np.ndarray) -> np.ndarray:
    return np.clip(p, LEAST, 1 - LEAST)


def proportions(q: np.ndarray) -> np.ndarray:
    q = np.maximum(q, LEAST)
    return q / q.sum(1, keepdims=True)


PACKED = "rsid string, alt binary, ref binary, fold binary"


def packed(d: DataFrame, names: list, folds: int, seed: int, parts: int) -> DataFrame:
    """A row a variant of called dosages: each sample's alternate and reference alleles and fold, or parts, as bytes."""
    kind = d.schema["sample_id"].dataType.simpleString()
    places = F.broadcast(d.sparkSession.createDataFrame([(s, k) for k, s in enumerate(names)], f"sample_id {kind}, at int"))
    fold = F.col("parts") if "parts" in d.columns else F.pmod(F.xxhash64("sample_id", "rsid", F.lit(seed)), F.lit(max(folds, 1))).cast("int")
    rows = d.select("sample_id", F.col("rsid").cast("string").alias("rsid"), F.col("dosage").cast("smallint").alias("a"), (F.col("ploidy") - F.col("dosage")).cast("smallint").alias("r"), fold.cast("smallint").alias("f"))
    rows = rows.join(places, "sample_id").repartition(parts, "rsid").groupBy("rsid").agg(*(F.collect_list(c).alias(c) for c in ("at", "a", "r", "f")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b.itertuples():
                cells = np.zeros((3, len(names)), np.uint8)
                cells[:, v.at] = v.a, v.r, v.f
                out.append((v.rsid, *(c.tobytes() for c in cells)))
            yield pd.DataFrame(out, columns=["rsid", "alt", "ref", "fold"])

    return rows.mapInPandas(pack, PACKED)


def start_p(rsid: str, alt: np.ndarray, ref: np.ndarray, models: list[Model], parts: np.ndarray | None = None) -> np.ndarray:
    def mean(m: Model) -> float:
        a, r = (alt, ref) if m.part is None else (x[(parts >> m.part & 1) > 0] for x in (alt, ref))
        return a.sum() / max(1, a.sum() + r.sum())

    return np.concatenate([np.clip(mean(m) + SPREAD * (uniform(rsid, m.seed, m.k) - 0.5), 0.02, 0.98) for m in models])


def used(m: Model, fold: np.ndarray) -> np.ndarray | None:
    """Which calls of a block a model is fitted to; None for all."""
    if m.part is not None:
        return (fold >> m.part & 1) > 0
    return None if m.fold is None else fold != m.fold


#: A variant's row keeps all models' frequencies one after another: those of this state, and of the two before it.
ROWS = f"kind int, {PACKED}, p0 binary, p1 binary, p2 binary, model int, block int, cells binary"


def fit(
    d: DataFrame, models: list[Model], folds: int = 0, tolerance: float = 1e-4, most_rounds: int | None = 300, accelerate: bool = True, seed: int = 7, relax: bool = False,
) -> Fits:
    """Fits ``models`` to ``d (sample_id, rsid, dosage)``, which may have ``ploidy`` (alleles a call counts; null is 2).

    A model stops when its likelihood rises by less than ``tolerance`` over a cycle (three rounds, or one without
    ``accelerate``), or after ``most_rounds`` (None: it always goes on to the end, which comes, as likelihoods have a bound);
    ``likelihood`` is that at the beginning of its last cycle. With ``relax`` a round is one of block relaxation. A model with a ``fold`` leaves out the calls whose hash of sample and
    variant gives that fold of ``folds``; ``cv`` is the mean deviance of those calls under what was fitted. If ``d`` has
    ``parts``, bits that say which parts a call is of, there are no folds, and a model with a ``part`` is fitted to its calls,
    samples and variants alone. Models don't act on each other. Missing dosages say nothing, and a sample or variant without any isn't part of the results; repeated
    calls of one sample and variant count once, the last that comes. Samples are bounded by ``MOST_BYTES``, with an error.
    """
    began, spark = time.monotonic(), d.sparkSession
    parted = ["parts"] if "parts" in d.columns else []
    if parted and folds:
        raise ValueError("folds of parts")
    width = sum(m.k + sent(m, relax) for m in models)
    most = MOST_BYTES // (8 * 2 * max(1, width))
    ploidy = F.coalesce(F.col("ploidy"), F.lit(2)) if "ploidy" in d.columns else F.lit(2)
    # Written as they come: a filter before that would make what dosages are derived from once more.
    d = written(d.select("sample_id", "rsid", "dosage", ploidy.alias("ploidy"), *parted))
    called = d.where("dosage is not null and parts > 0" if parted else "dosage is not null")
    found = called.groupBy("sample_id").agg(F.count("*"), F.bit_or("parts" if parted else F.lit(0))).orderBy("sample_id").limit(most + 1).collect()
    names = [r[0] for r in found]
    if len(names) > most:
        raise ValueError(f"over {most} samples for {width} components in all models")
    kind = d.schema["sample_id"].dataType.simpleString()
    n = len(names)
    states = [State([proportions(0.5 + np.array([uniform(str(s), m.seed, m.k) for s in names]).reshape(n, m.k))]) for m in models]
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(r[1] for r in found) // TASK_CALLS))
    given = GIVEN // max(1, n)
    with by_files(spark, given):
        calls = written(packed(called, names, folds, seed, parts))
    discard(d)
    table, phase, rounds = None, 0, 0
    while n and not all(s.done for s in states) and (most_rounds is None or rounds < most_rounds):
        before = calls if table is None else table
        with by_files(spark, given):
            table, figures, sums = one_round(spark, before, models, states, phase, n, accelerate, relax)
        discard(before)
        rounds += 1
        for i, (m, s) in enumerate(zip(models, states, strict=True)):
            if not s.done:
                advance(s, phase, figures[i], proportions(relaxed_q(s.q[-1], sums[i]) if relax else s.q[-1] * sums[i]), accelerate, tolerance)
        phase = (phase + 1) % 3 if accelerate else 0
    for s in states:
        s.final = final(s, (phase - 1) % 3 if accelerate else 2)
    with by_files(spark, given):
        cv = held_out(spark, table, models, states, n) if folds and table is not None else {}
    runs = [(i, m.k, m.fold, s.rounds, s.likelihood[-1] if s.likelihood else None, s.done, cv.get(i)) for i, (m, s) in enumerate(zip(models, states, strict=True))]
    own = [[at for at, r in enumerate(found) if m.part is None or r[2] >> m.part & 1] for m in models]
    q = [(i, names[at], c, float(s.q[s.final[0]][at, c])) for i, (m, s) in enumerate(zip(models, states, strict=True)) for at in own[i] for c in range(m.k)]
    trace = [(i, r, x) for i, s in enumerate(states) for r, x in enumerate(s.likelihood)]
    make = spark.createDataFrame
    return Fits(
        make(runs, "model int, k int, fold int, rounds int, likelihood double, converged boolean, cv double"), make(trace, "model int, round int, likelihood double"),
        make(q, f"model int, sample_id {kind}, component int, q double"), frequencies(spark, table, models, states), rounds, time.monotonic() - began,
    )


def advance(s: State, phase: int, figures: np.ndarray, after: np.ndarray, accelerate: bool, tolerance: float) -> None:
    """Takes a round's result: ``figures`` are the likelihood where it began and, of the frequencies, |r|^2 and |v|^2."""
    s.rounds += 1
    likelihood = float(figures[0])
    if not accelerate:
        s.done = bool(s.likelihood) and likelihood - s.likelihood[-1] < tolerance
        s.likelihood.append(likelihood)
        s.q = [after]
        return
    if phase == 0:
        s.done = bool(s.likelihood) and likelihood - s.likelihood[-1] < tolerance
        s.likelihood.append(likelihood)
        s.accepted = True
        s.q = s.q if s.done else [s.q[0], after]
    elif phase == 1:
        s.inner = [likelihood]
        s.q = [*s.q, after]
        r = s.q[1] - s.q[0]
        v = (s.q[2] - s.q[1]) - r
        rr, vv = float((r**2).sum() + figures[1]), float((v**2).sum() + figures[2])
        s.step = -max(1.0, np.sqrt(rr / vv)) if vv > 0 else -1.0
        s.q.append(proportions(s.q[0] - 2 * s.step * r + s.step**2 * v))
    else:
        s.accepted = likelihood >= s.inner[0]
        s.q = [after if s.accepted else s.q[2]]


def final(s: State, phase: int) -> tuple[int, int]:
    """Which of the proportions and of the frequencies are the furthest, if a round of that ``phase`` was the last."""
    if s.done or phase == 2 or not s.rounds:
        return 0, 0 if s.done or s.accepted else 2
    return phase + 1, phase + 1


def sent(m: Model, relax: bool) -> int:
    """Sums for a sample's proportions: what multiplies them, or a gradient and half of a curvature."""
    return m.k + relax * (m.k * (m.k + 1) // 2)


def one_round(spark, table: DataFrame, models: list[Model], states: list[State], phase: int, n: int, accelerate: bool, relax: bool = False) -> tuple[DataFrame, np.ndarray, list[np.ndarray]]:
    """One pass over the calls for all models: the next table, and each model's figures and sums for its proportions."""
    shared = spark.sparkContext.broadcast([(s.q[-1], s.step, s.accepted, s.done) for s in states])
    cuts = np.cumsum([0, *(m.k for m in models)]).tolist()
    fresh = "p0" not in table.columns

    schema = pa.schema([("kind", pa.int32()), ("rsid", pa.string()), *((c, pa.binary()) for c in ("alt", "ref", "fold", "p0", "p1", "p2")), ("model", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])

    def rows(columns: dict, count: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        figures = np.zeros((len(models), 3))
        sums = [np.zeros((sent(m, relax), n)).T for m in models]
        going = [i for i, s in enumerate(state) if not s[3]]
        turned = {i: (np.ascontiguousarray(state[i][0].T), products(state[i][0])) for i in going if relax}
        step_rows = max(1, CELLS // max(1, n))
        for whole in batches:
            cells = [matrix(whole[c], n) for c in ("alt", "ref", "fold")]
            p = history(whole, *cells, models, fresh)
            mine = {i: [x[:, cuts[i] : cuts[i + 1]] for x in p] for i in going}
            here = {i: begin(mine[i], phase, *state[i][1:3]) for i in going}
            after = {i: x.copy() for i, x in here.items()}
            slopes = {i: np.zeros((whole.num_rows, sent(models[i], relax))) for i in going}
            for i, some, calls in blocks(cells, models, going, step_rows, counted):
                if relax:
                    likelihood, slopes[i][some] = ascent(calls, state[i][0], *turned[i], here[i][some])
                else:
                    likelihood, after[i][some], add = expectation(calls, state[i][0], here[i][some])
                    sums[i] += add
                figures[i, 0] += likelihood
            if relax:
                for i in going:  # all variants at once
                    after[i] = relaxed_p(here[i], slopes[i])
                for i, some, calls in blocks(cells, models, going, step_rows, numbers):
                    sums[i] += pulls(*calls, turned[i][0], after[i][some])
            for i in going:
                m, x = mine[i], after[i]
                if phase == 0:
                    m[0][:], m[1][:] = here[i] if accelerate else x, x
                elif phase == 1:
                    m[2][:] = x
                    one = m[1] - m[0]
                    figures[i, 1:] += (one**2).sum(), (((m[2] - m[1]) - one) ** 2).sum()
                else:
                    m[0][:] = x  # if it is not accepted, the next round begins at p2
            after = {f"p{j}": pa.array([x.tobytes() for x in p[j]], pa.binary()) for j in range(3)}
            yield rows({"kind": pa.array(np.zeros(whole.num_rows, np.int32)), **{c: whole[c] for c in ("rsid", "alt", "ref", "fold")}, **after}, whole.num_rows)
        # A model's figures are added up at the end of its first block of sums.
        out = [(i, k, sums[i][first : first + BLOCK].tobytes() + (b"" if k else figures[i].tobytes())) for i, s in enumerate(state) if not s[3] for k, first in enumerate(range(0, n, BLOCK))]
        made = {c: pa.array([x[j] for x in out], schema.field(c).type) for j, c in enumerate(("model", "block", "cells"))}
        yield rows({"kind": pa.array(np.ones(len(out), np.int32)), **made}, len(out))

    after = written(table.mapInArrow(run, ROWS))
    sums, figures = [np.zeros((n, sent(m, relax))) for m in models], np.zeros((len(models), 3))
    totals = after.where("kind = 1").select("model", "block", "cells")
    if len(table.inputFiles()) * 8 * n * sum(sent(m, relax) for m in models) > FEW_BYTES:
        totals = added_up(totals, ["model", "block"])  # as large as the proportions
    for r in totals.collect():
        cells = np.frombuffer(r.cells)
        if r.block == 0:
            cells, figures[r.model] = cells[:-3], figures[r.model] + cells[-3:]
        sums[r.model][r.block * BLOCK : (r.block + 1) * BLOCK] += cells.reshape(-1, sent(models[r.model], relax))
    shared.unpersist()
    return after.where("kind = 0"), figures, sums


def matrix(column: pa.Array, width: int, kind: type = np.uint8) -> np.ndarray:
    """A column of binary values of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def history(b: pa.RecordBatch, alt: np.ndarray, ref: np.ndarray, fold: np.ndarray, models: list[Model], fresh: bool) -> list[np.ndarray]:
    """The three states of the frequencies of a block of variants, variants by components of all models."""
    if fresh:
        first = np.array([start_p(name, a, r, models, f) for name, a, r, f in zip(b["rsid"].to_pylist(), alt, ref, fold, strict=True)]).reshape(len(alt), -1)
        return [first, first.copy(), first.copy()]
    width = sum(m.k for m in models)
    return [matrix(b[f"p{j}"], width, np.float64).copy() for j in range(3)]


def begin(p: list[np.ndarray], phase: int, step: float, accepted: bool) -> np.ndarray:
    """The frequencies at which a round begins."""
    if phase == 0:
        return bounded(p[0] if accepted else p[2])
    if phase == 1:
        return p[1]
    r = p[1] - p[0]
    return bounded(p[0] - 2 * step * r + step**2 * ((p[2] - p[1]) - r))


@dataclass
class Counted:
    """Alternate and reference alleles of a block of calls, and for the first allele of each call, the second and so on how
    its chance follows from the alternate one's: ``sign * up + constant``, which is 1 for what is missing."""

    alt: np.ndarray
    ref: np.ndarray
    factors: list[tuple[np.ndarray, np.ndarray]]


def counted(alt: np.ndarray, ref: np.ndarray) -> Counted:
    every = alt.astype(np.int16) + ref
    most, factors = int(every.max(initial=0)), []
    for k in range(most if most <= MOST_FACTORS else 0):
        up = (alt > k).astype(float)
        factors.append((2 * up - (every > k), 1 - up))
    return Counted(alt.astype(float), ref.astype(float), factors)


def log_chance(c: Counted, up: np.ndarray, down: np.ndarray) -> float:
    """The sum of alt * log(up) + ref * log(down): a logarithm is taken of a product over as many rows as a double can hold."""
    if not c.factors:
        return float((c.alt * np.log(up)).sum() + (c.ref * np.log(down)).sum()) if len(c.alt) else 0.0
    chance = None
    for sign, constant in c.factors:
        factor = sign * up
        factor += constant
        chance = factor if chance is None else np.multiply(chance, factor, out=chance)
    rows = MOST_FACTORS // len(c.factors)
    return sum(float(np.log(np.multiply.reduce(chance[k : k + rows])).sum()) for k in range(0, len(chance), rows))


def expectation(c: Counted, q: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The likelihood of a block of calls, its next frequencies, and what multiplies the samples' proportions."""
    turned = np.ascontiguousarray(q.T)
    up = p @ turned
    down = 1 - up
    likelihood = log_chance(c, up, down)
    a, r = np.divide(c.alt, up, out=up), np.divide(c.ref, down, out=down)
    ups, downs = p * (turned @ a.T).T, (1 - p) * (turned @ r.T).T
    add = (p.T @ a + (1 - p).T @ r).T
    return likelihood, bounded(ups / np.maximum(ups + downs, 1e-300)), add


def numbers(alt: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return alt.astype(float), ref.astype(float)


def blocks(cells: list[np.ndarray], models: list[Model], going: list[int], step_rows: int, make: Callable) -> Iterator[tuple]:
    """``(model, rows, make(alt, ref))``: the calls that each model is fitted to, by blocks of rows; made once for models of the same calls."""
    for at in range(0, len(cells[0]), step_rows):
        alt, ref, fold = (x[at : at + step_rows] for x in cells)
        kept = {}
        for i in going:
            m = models[i]
            if (m.fold, m.part) not in kept:
                which = used(m, fold)
                if m.part is None:
                    rows, those = slice(at, at + len(alt)), slice(None)
                else:  # variants of the part
                    those = np.flatnonzero(which.any(1))
                    rows = at + those
                kept[m.fold, m.part] = rows, make(*(x[those] if which is None else (x * which)[those] for x in (alt, ref)))
            yield i, *kept[m.fold, m.part]


def ascent(c: Counted, q: np.ndarray, turned: np.ndarray, qq: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
    """The likelihood of a block of calls, and each variant's gradient and curvature (its upper half)."""
    up = p @ turned
    down = 1 - up
    likelihood = log_chance(c, up, down)
    a, r = c.alt / up, c.ref / down
    gradient = (a - r) @ q
    a /= up
    r /= down
    a += r
    return likelihood, np.hstack([gradient, a @ qq])


def relaxed_p(p: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """The variants' next frequencies, from what ``ascent`` gives."""
    k = p.shape[1]
    gradient, curvature = slopes[:, :k], whole(slopes[:, k:])
    return bounded(p + shortened(best_in_box(p, gradient, curvature), curvature))


def pulls(alt: np.ndarray, ref: np.ndarray, turned: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Each sample's gradient and curvature (its upper half) of a block of calls."""
    up = p @ turned
    down = 1 - up
    a, r = alt / up, ref / down
    gradient = p.T @ a + (1 - p).T @ r
    a /= up
    r /= down
    return np.vstack([gradient, products(p).T @ a + products(1 - p).T @ r]).T


def relaxed_q(q: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The samples' next proportions, from ``relaxed``'s sums."""
    k = q.shape[1]
    gradient, curvature = sums[:, :k], whole(sums[:, k:])
    return q + shortened(best_of_shares(q, gradient, curvature), curvature)


def products(x: np.ndarray) -> np.ndarray:
    """A row's products of two of its numbers, each pair once."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


def whole(half: np.ndarray) -> np.ndarray:
    """Symmetric matrices from their upper halves."""
    k = int(np.sqrt(2 * half.shape[1]))
    i, j = np.triu_indices(k)
    out = np.empty((len(half), k, k))
    out[:, i, j] = out[:, j, i] = half
    return out


def best_in_box(p: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Steps d up gradient * d - d * curvature * d / 2 that stay in the bounds of frequencies, by exact steps of one coordinate."""
    d, left = np.zeros_like(p), gradient.copy()
    for _ in range(SWEEPS):
        for c in range(p.shape[1]):
            step = bounded(p[:, c] + d[:, c] + left[:, c] / (curvature[:, c, c] + RIDGE)) - p[:, c] - d[:, c]
            d[:, c] += step
            left -= step[:, None] * curvature[:, :, c]
    return d


def best_of_shares(q: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The like for proportions, which keep their sum: what one gets, another gives."""
    d, left = np.zeros_like(q), gradient.copy()
    for _ in range(SWEEPS):
        for b, c in itertools.combinations(range(q.shape[1]), 2):
            bend = curvature[:, b, b] + curvature[:, c, c] - 2 * curvature[:, b, c] + RIDGE
            least, most = np.minimum(LEAST - q[:, b] - d[:, b], 0), np.maximum(q[:, c] + d[:, c] - LEAST, 0)
            step = np.clip((left[:, b] - left[:, c]) / bend, least, most)
            d[:, b] += step
            d[:, c] -= step
            left -= step[:, None] * (curvature[:, :, b] - curvature[:, :, c])
    return d


def shortened(d: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Steps that don't lower a self-concordant likelihood."""
    length = np.sqrt(np.maximum((np.matmul(curvature, d[:, :, None])[:, :, 0] * d).sum(1), 0))
    return d / (1 + length)[:, None]


def held_out(spark, table: DataFrame, models: list[Model], states: list[State], n: int) -> dict[int, float]:
    """The mean deviance of the calls that each model with a fold left out."""
    shared = spark.sparkContext.broadcast([s.q[s.final[0]] for s in states])
    cuts = np.cumsum([0, *(m.k for m in models)]).tolist()
    at = [s.final[1] for s in states]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step_rows, deviance, calls = max(1, CELLS // max(1, n)), np.zeros(len(models)), np.zeros(len(models), np.int64)
        for b in batches:
            cells = [matrix(b[c], n) for c in ("alt", "ref", "fold")]
            p = {j: matrix(b[f"p{j}"], cuts[-1], np.float64) for j in set(at)}
            for first in range(0, b.num_rows, step_rows):
                alt, ref, fold = (x[first : first + step_rows] for x in cells)
                for i, m in enumerate(models):
                    if m.fold is None:
                        continue
                    left = (fold == m.fold) & ((alt > 0) | (ref > 0))
                    x, y = alt[left].astype(float), ref[left].astype(float)
                    total, mean = x + y, (bounded(p[at[i]][first : first + step_rows, cuts[i] : cuts[i + 1]]) @ shared.value[i].T)[left]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        each = np.where(x > 0, x * np.log(x / (total * mean)), 0.0) + np.where(y > 0, y * np.log(y / (total * (1 - mean))), 0.0)
                    deviance[i] += float(2 * each.sum())
                    calls[i] += int(left.sum())
        own = [i for i, m in enumerate(models) if m.fold is not None]
        yield pa.RecordBatch.from_pydict({"model": pa.array(own, pa.int32()), "deviance": pa.array(deviance[own]), "calls": pa.array(calls[own])})

    found = table.mapInArrow(run, "model int, deviance double, calls long").groupBy("model").agg((F.sum("deviance") / F.nullif(F.sum("calls"), F.lit(0))).alias("cv")).collect()
    return {r["model"]: r["cv"] for r in found}


def frequencies(spark, table: DataFrame | None, models: list[Model], states: list[State]) -> DataFrame:
    """``(model, rsid, p)`` of the table that the last round wrote."""
    schema = "model int, rsid string, p array<double>"
    if table is None:
        return spark.createDataFrame([], schema)
    cuts = list(itertools.pairwise(np.cumsum([0, *(m.k for m in models)]).tolist()))
    kept = [s.final[1] for s in states]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = {j: np.frombuffer(b"".join(b[f"p{j}"])).reshape(len(b), -1) for j in set(kept)}
            for i, (first, end) in enumerate(cuts):
                own = np.array([models[i].part is None or any(x >> models[i].part & 1 for x in set(f)) for f in b["fold"]], bool)
                yield pd.DataFrame({"model": i, "rsid": b["rsid"][own].to_list(), "p": list(p[kept[i]][own, first:end])})

    return table.select("rsid", "fold", "p0", "p1", "p2").mapInPandas(run, schema)
