"""Removal of passages that occur earlier in the corpus, by super-k-mers.

Consecutive windows of ``WINDOW`` words that share a minimiser (their least hash of ``MER`` words) travel as one packed
string to the minimiser's bucket; equal windows share a minimiser, so they meet there, are sorted and counted exactly.

A minimiser that holds more than a bucket should (a frequent phrase in ever other contexts) is split: its windows go by a
hash of all their words, which equal windows share as well. Which are heavy is judged on a sample, and bounded: one that
isn't listed holds under a ``HEAVY``-th of all packed bytes. The list decides where windows meet, never whether they do.

Of equal packed strings in one batch of documents only the earliest travels: every window of the others starts earlier
in it, and their words are marked at once. So a passage in a third of all documents sends one string a batch. Where the
batches are so many that even these are too much for a bucket, the minimiser is crowded and its strings meet in two steps:
first those of a share of the batches (about the root of their number), then what no earlier place in its share accounts
for, at most one place of a window from each share.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, release, values, written

WINDOW, MER = 20, 5
#: Windows in a packed string at most, so that a text of one word does not make one huge string.
RUN = 128
#: Bytes of text whose packed strings are sought and compared in a bucket, and that a task packs at once.
BUCKET_BYTES, BATCH_BYTES = 4 << 20, 6 << 20
#: A minimiser is heavy above so many packed bytes, by a sample of one document in ``SAMPLE``; ``HEAVY`` are listed at most.
HEAVY_BYTES, SAMPLE, HEAVY = 2 * BUCKET_BYTES, 64, 1_000_000
#: Partitions of the shuffle at most; each sorts its buckets and reads them one by one.
PARTITIONS = 20_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LEAST = -(1 << 63)


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """The minimiser of each window of a text of at least ``WINDOW`` words."""
    n = len(hashes) - MER + 1
    mers = np.zeros(n, np.uint64)
    for k in range(MER):
        mers = (mers ^ hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        mers ^= mers >> np.uint64(32)
    width, least = 1, mers
    while 2 * width <= WINDOW - MER + 1:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if rest := WINDOW - MER + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    return least


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each window's words."""
    sums = np.zeros(len(hashes) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        sums = (sums ^ hashes[k : k + len(sums)]) * np.uint64(0x9E3779B97F4A7C15)
        sums ^= sums >> np.uint64(29)
    return sums


def among(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which ``hashes`` are in the sorted ``listed``."""
    return listed[np.searchsorted(listed[:-1], hashes)] == hashes if len(listed) else np.zeros(len(hashes), bool)


def super_kmers(words: list[bytes], known: WordHashes, heavy: np.ndarray, crowded: np.ndarray) -> Iterator[tuple[int, int, bytes, bool]]:
    """``(key, first window, packed words, whether crowded)`` that together hold each window of ``words`` once.

    The key is the windows' minimiser or, for one of the sorted ``heavy``, their hash; ``crowded`` is a sorted list too.
    """
    if len(words) < WINDOW:
        return
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    least = minimisers(hashes)
    many, split = among(least, crowded), among(least, heavy)
    if split.any():
        least = np.where(split, window_hashes(hashes), least)
    cuts = np.flatnonzero((least[1:] != least[:-1]) | (many[1:] != many[:-1])) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(least)]])
    if (ends - starts).max() > RUN:
        starts = np.unique(np.concatenate([np.arange(a, b, RUN) for a, b in zip(starts, ends, strict=True)]))
        ends = np.concatenate([starts[1:], [len(least)]])
    text = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    froms, tos = at[starts].tolist(), (at[ends + WINDOW - 1] - 1).tolist()
    for m, s, a, b, c in zip(least[starts].tolist(), starts.tolist(), froms, tos, many[starts].tolist(), strict=True):
        yield m, s, text[a:b], c


def listed_minimisers(docs: DataFrame, batches: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted heavy and crowded minimisers, by a sample of ``docs (id, mark, text)``.

    A heavy one holds more than ``HEAVY_BYTES`` of different packed strings; of a crowded one so much is sent by
    ``batches`` that each send a string once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = WordHashes(), np.zeros(0, np.uint64)
        for b in batches:
            for text in values(b.column(0)):
                found = [(m, xxhash.xxh64_intdigest(string), len(string)) for m, _, string, _ in super_kmers((text or b"").split(), known, none, none)]
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns], ["minimiser", "string", "bytes"])

    sample = docs.where(F.pmod(F.xxhash64("id", "mark"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary"))
    strings = sample.mapInArrow(run, "minimiser long, string long, bytes long").groupBy("minimiser", "string").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    sent = F.sum(F.col("bytes") * F.least(F.col("n") * SAMPLE, F.lit(batches)))
    held = strings.groupBy("minimiser").agg((F.sum("bytes") * SAMPLE).alias("bytes"), sent.alias("sent"))
    over = held.where(F.greatest("bytes", "sent") > HEAVY_BYTES).orderBy(F.greatest("bytes", "sent").desc(), "minimiser").limit(HEAVY).toPandas()
    return tuple(np.sort(over.loc[over[c] > HEAVY_BYTES, "minimiser"].to_numpy(np.int64).view(np.uint64)) for c in ("bytes", "sent"))


#: A bucket of crowded minimisers' first step is below zero and has ``keys``, by which what is left meets in the second.
PACKED = "bucket int, ids array<long>, marks array<long>, starts array<int>, ends array<int>, strings binary, keys array<long>"
#: A range of words or, with ``string``, a packed string that is left for the second step.
RANGES = "id long, mark long, start int, end int, key long, string binary"


def packed(docs: DataFrame, buckets: int, listed: tuple[np.ndarray, np.ndarray], shares: int) -> DataFrame:
    """Rows for buckets: packed strings with their places, or word ranges already known to be repeats (``ends``).

    The batches of documents are dealt to ``shares`` shares, which keep crowded minimisers apart.
    """
    listed = docs.sparkSession.sparkContext.broadcast(listed)  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squeeze, (heavy, crowded) = WordHashes(), zstandard.ZstdCompressor(level=1), listed.value
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            sizes = np.cumsum(pc.binary_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
                share = xxhash.xxh32_intdigest(f"{part} {done}") % shares
                yield pack_batch(b.slice(at, end - at), known, squeeze, buckets, heavy, crowded, shares, share)
                at, done = end, done + 1
        known.clear()
        release()

    return docs.select("id", "mark", F.col("text").cast("binary")).mapInArrow(run, PACKED)


def pack_batch(batch: pa.RecordBatch, known: WordHashes, squeeze: zstandard.ZstdCompressor, buckets: int, heavy: np.ndarray, crowded: np.ndarray, shares: int, share: int) -> pa.RecordBatch:
    first: dict[bytes, tuple[int, int, int, int, bool]] = {}  # the earliest place of a string: id, start, mark, key, crowded
    alike: list[tuple[bytes, tuple[int, int, int, int, bool]]] = []  # further rows at that very place
    repeats: list[tuple[int, int, int, int]] = []
    for doc, mark, text in zip(*map(values, batch.columns), strict=True):
        for m, start, string, many in super_kmers((text or b"").split(), known, heavy, crowded):
            place = (doc, start, mark, m, many)
            if (was := first.setdefault(string, place)) is not place:
                if was[:2] == place[:2]:  # neither is earlier
                    if mark != was[2]:
                        alike.append((string, place))
                    continue
                if place < was:
                    first[string], place = place, was
                repeats.append((place[0], place[2], place[1], place[1] + string.count(b" ") + 1))
    held: dict[int, list] = {}
    wide = max(1, buckets // shares)
    for string, (doc, start, mark, m, many) in itertools.chain(first.items(), alike):
        held.setdefault(-1 - (m % wide * shares + share) if many else m % buckets, []).append((doc, mark, start, string, m - (1 << 63)))
    rows = []
    for bucket, lot in held.items():
        ids, marks, starts, strings, keys = zip(*lot, strict=True)
        rows.append((bucket, ids, marks, starts, None, squeeze.compress(b"\n".join(strings)), keys if bucket < 0 else None))
    if repeats:
        ids, marks, starts, ends = zip(*repeats, strict=True)
        rows.append((xxhash.xxh32_intdigest(str(repeats[0])) % buckets, ids, marks, starts, ends, None, None))
    types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Word ranges that a bucket's windows show to be repeats, those that were known before, and in a first step what is left."""
    out = [np.zeros((0, 4), np.int64)]
    left: list[tuple] = []
    ready = pdf[pdf["strings"].isna()]
    for r in ready.itertuples():
        out.append(np.column_stack([r.ids, r.marks, r.starts, r.ends]).astype(np.int64))
    pdf = pdf[pdf["strings"].notna()]
    if len(pdf):
        expand = zstandard.ZstdDecompressor()
        strings = [s for blob in pdf["strings"] for s in expand.decompress(blob).split(b"\n")]
        ids, marks, starts = (np.concatenate([np.asarray(x, np.int64) for x in pdf[k]]) for k in ("ids", "marks", "starts"))
        out.append(repeated_windows(strings, ids, marks, starts))
        if pdf["bucket"].iloc[0] < 0:
            whole = set(map(tuple, out[-1].tolist()))
            places = zip(ids.tolist(), marks.tolist(), starts.tolist(), np.concatenate(list(pdf["keys"])).tolist(), strings, strict=True)
            left = [p for p in places if (*p[:3], p[2] + p[4].count(b" ") + 1) not in whole]
    return range_rows(np.concatenate(out), left)


def range_rows(ranges: np.ndarray, left: list[tuple] = ()) -> pd.DataFrame:
    """Rows of ``RANGES``: ``ranges``, and strings ``left (id, mark, start, key, string)`` for the second step."""
    done = pd.DataFrame(ranges, columns=["id", "mark", "start", "end"]).assign(key=0, string=None)
    if left:
        more = pd.DataFrame(left, columns=["id", "mark", "start", "key", "string"]).assign(end=0)
        done = more[done.columns] if done.empty else pd.concat([done, more[done.columns]], ignore_index=True)
    return done.astype({"start": "int32", "end": "int32", "key": "int64"})


def second_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Word ranges that the strings left by the first step, of one bucket, show to be repeats."""
    return range_rows(repeated_windows(list(pdf["string"]), *(pdf[k].to_numpy(np.int64) for k in ("id", "mark", "start"))))


def repeated_windows(strings: list[bytes], ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows ``(id, mark, first word, word after the last)`` of each run of windows that start earlier elsewhere."""
    order = np.lexsort([marks, starts, ids])  # windows then come in order of place
    ids, marks, starts = ids[order], marks[order], starts[order]
    words = pc.split_pattern(pa.array(strings, pa.large_binary()).take(pa.array(order)), b" ")  # they are joined by one space
    lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
    flat = words.flatten().dictionary_encode().indices.to_numpy().astype(np.uint32)
    del words
    n = len(flat) - WINDOW + 1
    bases = np.cumsum(lengths) - lengths
    valid = np.ones(len(flat), bool)  # windows that stay in their string
    for k in range(1, WINDOW):
        valid[bases + lengths - k] = False
    at = np.flatnonzero(valid[:n])
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums = (sums ^ flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        sums ^= sums >> np.uint64(31)
    sums = sums[at]
    order = np.argsort(sums, kind="stable")
    new = np.concatenate([[True], sums[order[1:]] != sums[order[:-1]]])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    follow = np.flatnonzero(~new)
    if not len(follow):
        return np.zeros((0, 4), np.int64)
    here, there = at[order[follow]], at[order[lead[follow]]]
    same = np.ones(len(follow), bool)
    for k in range(WINDOW):
        same &= flat[here + k] == flat[there + k]
    if not same.all():  # different windows with one sum: compare the words themselves among all that share it
        firsts: dict[tuple[int, bytes], int] = {}
        mixed = np.isin(lead, lead[follow[~same]])
        for j in np.flatnonzero(mixed).tolist():
            i = at[order[j]]
            firsts.setdefault((int(lead[j]), flat[i : i + WINDOW].tobytes()), i)
        for j in np.flatnonzero(mixed[follow]).tolist():
            there[j] = firsts[(int(lead[follow[j]]), flat[here[j] : here[j] + WINDOW].tobytes())]
    owner = np.repeat(np.arange(len(ids)), lengths)
    place = starts[owner] + np.arange(len(flat)) - bases[owner]
    earlier = (ids[owner[there]] < ids[owner[here]]) | ((ids[owner[there]] == ids[owner[here]]) & (place[there] < place[here]))
    hit = np.sort(here[earlier])
    if not len(hit):
        return np.zeros((0, 4), np.int64)
    cut = np.concatenate([[True], (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])])
    a, b = hit[cut], hit[np.concatenate([cut[1:], [True]])]
    return np.column_stack([ids[owner[a]], marks[owner[a]], place[a], place[b] + WINDOW])


def keep_words(text: bytes | None, ranges: list | None) -> tuple[bytes | None, int, int, str]:
    """What is left of a text without the words in ``ranges``, its words before, those removed, and the digest."""
    words = (text or b"").split()
    if ranges is None or not len(ranges):
        return text, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        gone[r["start"]] += 1
        gone[r["end"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    kept, last, out = [], 0, []
    for m, g in zip(WORD.finditer(text), gone.tolist(), strict=True):
        if not g:
            kept.append(m[0])
            out.append(text[last : m.end()])  # a word keeps the white space before it
        last = m.end()
    return b"".join(out).strip(b" \t\n\r\x0b\x0c"), len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """``(id, mark, start, end)``: ranges of words of ``keyed (id, mark, text)`` that are repeats, which may overlap."""
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    batches = max(1, -(-total // BATCH_BYTES))
    heavy, crowded = listed_minimisers(keyed, batches)
    rows = packed(keyed, buckets, (heavy, crowded), math.isqrt(batches - 1) + 1)
    found = written(rows.repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInPandas(lambda pdf: repeated(pdf), RANGES))
    if len(crowded):
        left = found.where("string is not null").groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInPandas(lambda pdf: second_step(pdf), RANGES)
        found = found.where("string is null").unionByName(left)
    return found.select("id", "mark", "start", "end")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` as a column ``row``, with ``kept_text``, ``n_words``, ``n_removed`` and ``kept_sha256``.

    Each word goes that a window of ``WINDOW`` words covers whose words also start earlier: in a smaller doc_id, or
    earlier in the same document. A null id is smaller than any. Rows with one doc_id are one document to this order:
    of equal places neither is earlier. Null, empty and short texts have no windows. An empty table gives no rows.
    """
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64("text").alias("mark"), F.col("text").alias("text"), F.struct("*").alias("row")
    )
    ranges = repeated_ranges(keyed).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    forget(docs.sparkSession)

    @F.pandas_udf("kept_text binary, n_words long, n_removed long, kept_sha256 string")
    def cut(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        done = [keep_words(t, r) for t, r in zip(text, ranges, strict=True)]
        return pd.DataFrame(done, columns=["kept_text", "n_words", "n_removed", "kept_sha256"]).astype({"n_words": "int64", "n_removed": "int64"})

    joined = keyed.drop("text").join(ranges, ["id", "mark"], "left")
    out = joined.select("row", cut(F.col("row.text").cast("binary"), F.col("ranges")).alias("x")).select("row", "x.*")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``; see ``without_repeats`` for awkward ones."""
    return without_repeats(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
