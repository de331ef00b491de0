"""Runs of words that repeat with a period, by comparing a text's word ids with each of their shifts.

A text of n words is compared with itself shifted by every lag up to n / ``EXPONENT``; a stretch of equal words at lag q
that is long enough is a run with period q. A block of lags is one array comparison, and its true stretches are told
apart by the gaps between matches. Lags are cut into ranges of ``LAGS``: a text with one range is scanned where it lies,
the ranges of longer texts are dealt over the cluster, each with the text's ids, and their runs meet again by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: A run is at least so many words, and so many periods, long.
LENGTH, EXPONENT = 6, 4
#: Lags in a range. A text of n words travels n / (EXPONENT * LAGS) times, and a range is LAGS * n comparisons.
LAGS = 2048
#: Texts up to so many bytes have one range at most: a word and the space after it are two bytes or more.
SHORT_BYTES = 2 * EXPONENT * LAGS
#: Comparisons in a block of lags.
CELLS = 1 << 18
#: Copies of a long text's runs, so that the rows of one text repeated often meet them in as many groups.
SALTS = 32

RUN = "struct<start:long,period:long,length:long>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Each word's number, in the least type that also has a number no word has: the greatest."""
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    return np.array(ids, np.uint16 if len(known) < 0xFFFF else np.uint32)


def scan(ids: np.ndarray, first: int, last: int) -> dict[tuple[int, int], int]:
    """The least period from ``first`` to ``last`` of each ``(start, length)`` that is a maximal stretch of that period.

    A stretch whose least period is under ``first`` shows with a multiple of it, and is told apart by whoever has both.
    """
    n = len(ids)
    last = min(last, n // EXPONENT)
    found: dict[tuple[int, int], int] = {}
    if first > last:
        return found
    beyond = np.concatenate([ids, np.full(last, np.iinfo(ids.dtype).max, ids.dtype)])  # no word, so no stretch leaves its row
    rows = max(1, CELLS // n)
    for lag in range(first, last + 1, rows):
        lags = np.arange(lag, min(lag + rows, last + 1))
        shifts = np.lib.stride_tricks.as_strided(beyond[lag:], (len(lags), n), (ids.itemsize, ids.itemsize), writeable=False)
        at = np.flatnonzero(shifts == ids)
        if not len(at):
            continue
        cuts = np.flatnonzero(np.diff(at) != 1)
        begin = at[np.concatenate([[0], cuts + 1])]
        length = at[np.concatenate([cuts, [len(at) - 1]])] - begin + 1
        period = lags[begin // n]
        long = length + period >= np.maximum(LENGTH, EXPONENT * period)
        for b, m, q in zip((begin[long] % n).tolist(), (length + period)[long].tolist(), period[long].tolist(), strict=True):
            found.setdefault((b, m), q)  # periods come in ascending order
    return found


def kept(words: list[bytes], runs: Iterator[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run ``(start, period, length)`` contains after its first period."""
    marks, some = np.zeros(len(words) + 1, np.int64), False
    for start, period, length in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
        some = True
    return [w for w, m in zip(words, np.cumsum(marks[:-1]).tolist(), strict=True) if not m] if some else words


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs ``(start, period, length)`` of a text, in order."""
    if len(words) < LENGTH:
        return []
    return sorted((start, q, length) for (start, length), q in scan(word_ids(words), 1, len(words)).items())


COLUMNS = "n_words long, starts array<long>, periods array<long>, lengths array<long>, kept_text string"


def as_runs(x: Column) -> Column:
    zipped = F.arrays_zip(x["starts"], x["periods"], x["lengths"])
    return F.transform(zipped, lambda r: F.struct(r["starts"].alias("start"), r["periods"].alias("period"), r["lengths"].alias("length")))


def scan_short(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        found = runs_of(words)
        starts, periods, lengths = zip(*found, strict=True) if found else ((), (), ())
        out.append((len(words), starts, periods, lengths, b" ".join(kept(words, found)).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "starts", "periods", "lengths", "kept_text"]).astype({"n_words": "int64"})


def cut_long(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(texts, runs, strict=True):
        words = text.encode("utf-8", "surrogatepass").split()
        left = kept(words, ((r["start"], r["period"], r["length"]) for r in (() if found is None else found)))
        out.append((len(words), b" ".join(left).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "kept_text"]).astype({"n_words": "int64"})


def ids_of(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        ids = word_ids(text.encode("utf-8", "surrogatepass").split())
        out.append((len(ids), ids.itemsize == 4, ids.tobytes()))
    return pd.DataFrame(out, columns=["n", "wide", "ids"]).astype({"n": "int64", "wide": "bool"})


def scan_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            found = scan(np.frombuffer(r.ids, np.uint32 if r.wide else np.uint16), r.first, r.first + LAGS - 1)
            starts, lengths = np.array(list(found), np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"key": r.key, "start": starts, "length": lengths, "period": np.fromiter(found.values(), np.int64, len(found))})
    release()


def runs_of_long(texts: DataFrame) -> DataFrame:
    """``(key, runs)`` of different long texts ``(key, text)`` that have any."""
    ids = texts.select("key", F.pandas_udf(ids_of, "n long, wide boolean, ids binary")("text").alias("x")).select("key", "x.*")
    ranges = ids.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.floor(F.col("n") / EXPONENT)).cast("long"), F.lit(LAGS).cast("long"))))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number of partitions keeps Spark from merging these few bytes, which are much work, into few tasks.
    dealt = ranges.repartition(parts, "key", "first").mapInPandas(scan_ranges, "key binary, start long, length long, period long")
    least = dealt.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return least.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def collapsed(docs: DataFrame) -> DataFrame:
    """``(row, n_words, runs, kept_text)`` for every row of ``docs (text, ...)``, which ``row`` holds whole.

    ``runs`` lists ``(start, period, length)`` by start, then period: every stretch of at least ``LENGTH`` words and
    ``EXPONENT`` periods of its least period that no neighbouring word extends. ``kept_text`` is the words that no run
    contains after its first period, joined by one space. Null, empty and short texts have no runs, and what is left of
    a null text is empty. Texts are scanned whole at every lag, however long; the ids of one text, and the text itself,
    have to fit in a task. Repeated rows give the same row each. An empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("body"))
    small = F.coalesce(F.octet_length("body"), F.lit(0)) <= SHORT_BYTES
    here = rows.where(small).select("row", F.pandas_udf(scan_short, COLUMNS)("body").alias("x")).select("row", F.col("x.n_words").alias("n_words"), as_runs(F.col("x")).cast(f"array<{RUN}>").alias("runs"), "x.kept_text")

    salt = F.pmod(F.xxhash64(*(F.col("row").getField(f.name) for f in docs.schema if f.dataType.simpleString() in ("bigint", "int", "string"))), F.lit(SALTS))
    long = rows.where(~small).select("row", "body", F.unhex(F.sha2("body", 256)).alias("key"))
    found = runs_of_long(long.select("key", F.col("body").alias("text")).dropDuplicates(["key"]))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = long.drop("body").withColumn("salt", salt).join(found, ["key", "salt"], "left")
    dealt = joined.select("row", "runs", F.pandas_udf(cut_long, "n_words long, kept_text string")(F.col("row.text"), F.col("runs")).alias("x"))
    return here.unionByName(dealt.select("row", F.col("x.n_words").alias("n_words"), F.coalesce("runs", F.array()).cast(f"array<{RUN}>").alias("runs"), "x.kept_text"))


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of what ``collapsed`` gives.

    The four figures are those of the run with the greatest length / period, compared as fractions (ties: the smallest
    start, then period), and null without runs.
    """
    better = lambda a, b: a["start"].isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    none = F.lit(None).cast(RUN)
    best = F.aggregate("runs", F.struct(*(none[k].alias(k) for k in ("start", "period", "length"))), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "kept_text")
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of documents, where every tenth (by a checksum of its id) ends in a repeated passage.

    With h the unsigned CRC-32 of the id in decimal and g = h // 10: if h % 10 is 0 and there are words, words from
    a = g % n on become repeats of the p = 1 + (n - a) // (3 + g % 8) words at a, joined by one space. A null id has no tail.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("chosen"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The rest of the work is in one expression over the array, so that only chosen texts are split.
    n = lambda w: F.size(w).cast("long")
    a = lambda w: F.col("g") % n(w)
    p = lambda w: 1 + F.floor((n(w) - a(w)) / (3 + F.col("g") % 8))
    tail = lambda w: F.flatten(F.array_repeat(F.slice(w, (a(w) + 1).cast("int"), p(w).cast("int")), (3 + F.col("g") % 8).cast("int")))
    whole = lambda w: F.array_join(F.concat(F.slice(w, F.lit(1), a(w).cast("int")), F.slice(tail(w), F.lit(1), (n(w) - a(w)).cast("int"))), " ")
    made = F.transform(F.array(words), lambda w: F.when(n(w) > 0, whole(w)).otherwise(F.col("text")))[0]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("chosen") & F.col("text").isNotNull(), made).otherwise(F.col("text")).alias("text"))
