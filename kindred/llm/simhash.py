"""Near-duplicate documents: fingerprints compared exactly, tile against tile.

For groups of texts by the similarity of whole shingles (``representatives``, the pipeline's stage) the tiles are those of
texts that share a key made of least hashes, so the work grows with the groups and not with the square of the corpus.

A fingerprint's tile is the vector of its segments' population counts. Two fingerprints within ``radius`` bits have
tiles whose counts differ by no more than ``radius`` in sum, so all other pairs of tiles are skipped without loss.
The tiles that remain are compared by numpy's exclusive-or and bit count. Equal fingerprints are one row before any
comparison, so copies cost nothing; tiles above ``block`` fingerprints are cut into blocks, and each task compares
one block with one bounded group of visitors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, values, written

#: Segments of a fingerprint, by how many fingerprints there are: more segments leave fewer pairs of tiles (1.4 % of random
#: pairs with four, 0.025 % with eight) but send a row to more of them (20 and 64), which pays for large tables.
SEGMENTS, MANY_SEGMENTS, MANY = 4, 8, 30_000_000
#: Rows of the table of tiles that may be broadcast; there are at most 17**4 tiles of four segments, and 9**8 of eight.
BROADCAST_TILES = 17**4


def fingerprint(text: bytes | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's shingles as a signed 64-bit integer; 0 if it has no word.

    A-Z become lower case; a text with fewer words than a shingle is one shingle. Repeats count. A bit is 1 if it is
    set in more than half of the shingles' XXH64 values.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles: Iterator = iter([words])
        n = 1
    else:
        shingles = zip(*(words[k:] for k in range(words_in_shingle)), strict=False)
        n = len(words) - words_in_shingle + 1
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    while part := [digest(b" ".join(s), seed) for s in itertools.islice(shingles, 65536)]:
        bits += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, words_in_shingle) for t in values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, radius: int = 2, block: int = 4096, visitors: int = 16384, segments: int | None = None) -> DataFrame:
    """``(src, dst)``: edges that join the distinct fingerprints ``fps (fp)`` as all pairs within ``radius`` bits do.

    Each task gives a spanning forest of the links that it finds, so a dense group gives no more edges than rows.
    """
    segments = segments or (SEGMENTS if fps.count() <= MANY else MANY_SEGMENTS)
    bits = 64 // segments
    # One digit of a packed tile: a count, with room for a difference below or above.
    digit = 2 * bits if radius < bits else 4 * radius
    tile = sum(F.bit_count(F.shiftrightunsigned("fp", bits * s).bitwiseAND((1 << bits) - 1)).cast("long") * digit**s for s in range(segments))
    fps = fps.select("fp", tile.alias("tile"))
    # Steps to the tiles below in packed order; a step out of range meets no tile.
    steps = sorted({sum(d * digit**s for s, d in enumerate(v)) for v in short_vectors(segments, radius)})
    below = F.explode(F.array(*((F.col("tile") + F.lit(s).cast("long")) for s in steps if s < 0)))
    counts = written(fps.groupBy("tile").agg(F.count("*").alias("n")))
    guests = counts.select(below.alias("home"), F.col("n").alias("guests")).groupBy("home").agg(F.sum("guests").alias("guests"))
    homes = counts.join(guests, counts.tile == guests.home, "left").select(
        F.col("tile").alias("home"),
        F.ceil(F.col("n") / block).cast("int").alias("blocks"),
        F.ceil((F.col("n") * (F.col("n") > block).cast("int") + F.coalesce("guests", F.lit(0)) + 1) / visitors).cast("int").alias("groups"),
    )
    homes = written(homes)
    if segments == SEGMENTS or homes.count() <= BROADCAST_TILES:
        homes = F.broadcast(homes)
    own_block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    own_group = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("groups")).cast("int")
    own = fps.join(homes, fps.tile == homes.home)
    at_home = own.select("home", own_block.alias("block"), F.explode(F.expr("sequence(0, groups - 1)")).alias("group"), "fp", F.lit(True).alias("resident"))
    beside = own.where("blocks > 1").select("home", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), own_group.alias("group"), "fp", own_block.alias("mine")).where("block > mine")
    away = fps.select("fp", below.alias("at")).join(homes, F.col("at") == F.col("home"))
    away = away.select("home", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), own_group.alias("group"), "fp", F.lit(False).alias("resident"))
    rows = at_home.unionByName(beside.select("home", "block", "group", "fp", F.lit(False).alias("resident"))).unionByName(away)
    # A task's work is known from the counts, so many small ones share a bin of bounded size.
    total = counts.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total * len(steps) // 100_000))
    bin_of = F.pmod(F.xxhash64("home", "block", "group"), F.lit(bins)).cast("int")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "block", "group"], kind="stable")
        key = pdf[["home", "block", "group"]].to_numpy()
        fp, resident = pdf["fp"].to_numpy(np.int64), pdf["resident"].to_numpy(bool)
        cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        out = []
        for a, b in itertools.pairwise([0, *cuts, len(fp)]):
            if b - a > 1:
                out += spanning_links(fp[a:b][resident[a:b]], fp[a:b][~resident[a:b]], radius)
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return rows.withColumn("bin", bin_of).groupBy("bin").applyInPandas(compare, "src long, dst long")


def short_vectors(n: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Vectors of ``n`` whole numbers whose absolute values sum to ``radius`` at most."""
    if n == 0:
        yield ()
        return
    for first in range(-radius, radius + 1):
        for rest in short_vectors(n - 1, radius - abs(first)):
            yield (first, *rest)


def spanning_links(home: np.ndarray, guests: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``home`` and between ``home`` and ``guests``."""
    both = np.concatenate([home, guests]).view(np.uint64)
    label = np.arange(len(both))
    rows = max(1, 4_000_000 // max(1, len(both)))
    for at in range(0, len(home), rows):
        near = np.bitwise_count(both[at : at + rows, None] ^ both[None, :]) <= radius
        for i in np.flatnonzero(near.sum(1) > 1):
            found = np.unique(label[near[i]])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
    moved = np.flatnonzero(label != np.arange(len(both)))
    signed = both.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[label[moved]].tolist(), strict=True))


def near_duplicates(docs: DataFrame, radius: int = 2, words_in_shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links of ``radius`` or fewer differing bits reach, itself included.
    Null and blank texts share fingerprint zero; rows with equal doc_id are rows of their own; a null doc_id is
    never a component's id unless it is alone with others like it. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, words_in_shingle))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    component = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- Groups of similar documents, for the corpus pipeline: wider fingerprints, compared by the same tiles.

WIDE_BITS = 256
#: Bits for groups of fingerprints alone.
WIDE_RADIUS = 48
#: Texts of this similarity or more, by their five-word shingles with repeats, are near-duplicates.
SIMILARITY = 0.8
#: Bits within which fingerprints are candidates for it. At similarity 0.8 the angle's share is acos(2 * 0.8 / 1.8) / pi =
#: 0.15, so 39 of 256 bits are expected to differ, give or take 6; of four shingles against five it is 48, give or take 6,
#: hence more for texts of few. Texts that have nothing in common differ in 128, give or take 8.
CANDIDATE_RADIUS, SHORT, SHORT_RADIUS = 64, 8, 84
#: Texts of similarity 0.8 have shingle counts within this ratio.
LENGTH_RATIO = 1.25
#: Keys by which texts become candidates at all, and samples a key is made of: texts of similarity 0.8 share none of the
#: keys with probability (1 - 0.8 ** 6) ** 32 = 0.00006, those of 0.2 share one with probability 0.002.
BANDS, ROWS_A_BAND = 32, 6
#: Rows of at most 100 bytes that are broadcast to save a shuffle of texts or keys.
BROADCAST_ROWS = 1_000_000
#: What one task of the exact comparison holds of a side, in texts and in bytes of their shingles' hashes.
TEXTS_A_BLOCK, BYTES_A_BLOCK = 4096, 16 << 20
#: One seed for each 64 bits of a wide fingerprint, and what decides a bit that is set in half of the shingles.
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
TIES = np.unpackbits(SEEDS.view(np.uint8)).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser of each value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Where the bins of ``minima`` begin, and the order in which each looks for another that isn't empty.
BINS = (np.arange(BANDS * ROWS_A_BAND, dtype=np.float64) / (BANDS * ROWS_A_BAND) * 2.0**64).astype(np.uint64)
PROBES = (mixed(np.arange(1, len(BINS) * 64 + 1, dtype=np.uint64)) % np.uint64(len(BINS))).astype(np.int64).reshape(len(BINS), 64)


def shingle_set(text: bytes | None, words_in_shingle: int = 5) -> np.ndarray:
    """64-bit hashes of a text's shingles in order, the second occurrence of a shingle being another element than the first.

    So the similarity of two such sets is that of the shingles with repeats.
    """
    words = (text or b"").lower().split()
    n = max(1, len(words) - words_in_shingle + 1) if words else 0
    shingles = iter([words]) if n == 1 else zip(*(words[k:] for k in range(words_in_shingle)), strict=False)
    digest = xxhash.xxh3_64_intdigest
    out = np.sort(np.fromiter((digest(b" ".join(s)) for s in shingles), np.uint64, n)) if n else np.zeros(0, np.uint64)
    again = np.append(False, out[1:] == out[:-1]) if n else np.zeros(0, bool)
    if again.any():
        places = np.arange(n)
        nth = places - np.maximum.accumulate(np.where(again, 0, places))
        out[again] ^= mixed(nth[again].astype(np.uint64))
        out.sort()
    return out


def wide_bits(hashes: np.ndarray) -> bytes:
    """A SimHash of ``WIDE_BITS`` bits over hashes; zeros if there are none."""
    bits = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 16384):
        made = mixed(hashes[at : at + 16384, None] + SEEDS)
        bits += np.unpackbits(made.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * bits + TIES > len(hashes)).tobytes() if len(hashes) else bytes(WIDE_BITS // 8)


def wide_fingerprint(text: bytes | None, words_in_shingle: int = 5) -> tuple[bytes, int]:
    """A SimHash of ``WIDE_BITS`` bits, and how many shingles it is made of; zeros and 0 if the text has no word."""
    hashes = shingle_set(text, words_in_shingle)
    return wide_bits(hashes), len(hashes)


def minima(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a sorted set of hashes: sets of similarity s agree in each with probability ``s ** ROWS_A_BAND``.

    The range of hashes is cut into bins, and a bin's least hash is one sample of the set; an empty bin takes that of
    another, sought in an order of its own, so that small sets are sampled as often as large ones.
    """
    at = np.searchsorted(hashes, BINS)
    full = np.append(at[1:], len(hashes)) > at
    source = np.arange(len(BINS))
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = PROBES[empty]
        hit = full[probes]
        source[empty] = probes[np.arange(len(empty)), hit.argmax(1)]
        rest = empty[~hit.any(1)]
        known = np.flatnonzero(full)
        source[rest] = known[np.searchsorted(known, rest) % len(known)]
    least = hashes[at[source]].reshape(BANDS, ROWS_A_BAND)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS_A_BAND):
        keys = mixed(keys ^ least[:, k])
    return keys


def buckets(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that two or more of ``wide (node, keys)`` share, as ``(key, hub, n)``, and their members ``(key, hub, n, node)``.

    The hub is a key's least node. Copies with small changes share many keys; of keys with the same members one stays.
    """
    rows = wide.select("node", F.explode("keys").alias("key"))
    held = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"), F.min("node").alias("hub")).where("n > 1")
    held = written(held.groupBy("n", "all").agg(F.min(F.struct("key", "hub")).alias("x")).select("x.key", "x.hub", "n"))
    return held, rows.join(beside(held), "key")


def beside(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table for a join: broadcast if there are ``BROADCAST_ROWS`` at most, so that the other side stays
    where it is.
    """
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_links(wide: DataFrame, radius: int = WIDE_RADIUS, block: int = 8192) -> DataFrame:
    """``(src, dst)`` over fingerprints ``wide (node, fp, size, keys)``: forests that join those that share a key, are within
    ``radius`` bits and of like length.

    Small groups share tasks; a group above ``block`` is cut into blocks, and a pair of blocks is a task. In a task rows
    are in order of population count, and tiles whose counts differ by more than ``radius`` are skipped.
    """
    held, members = buckets(wide)
    bins = max(1, -(-(held.where(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0) // (4 * block)))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = members.select("key", "node", blocks.alias("blocks")).join(wide.select("node", "fp", "size"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    alone = F.col("blocks") == 1
    cell = F.struct(
        F.when(alone, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("of"),
        F.when(alone, -1).otherwise(F.least("block", "other")).alias("low"),
        F.when(alone, -1).otherwise(F.greatest("block", "other")).alias("high"),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        fps = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
        size, nodes, block = (pdf[c].to_numpy(np.int64) for c in ("size", "node", "block"))
        cell = pdf["cell"].iloc[0]
        whole = cell["low"] == cell["high"]  # groups or a block by themselves
        key = pdf["key"].to_numpy()
        out: list[tuple[int, int]] = []
        for a, b in itertools.pairwise([0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]):
            rows = np.arange(a, b)
            home, guests = (rows, rows) if whole else (rows[block[a:b] == cell["low"]], rows[block[a:b] == cell["high"]])
            out += tile_links(fps, size, home, guests, nodes, radius)
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return rows.select(cell.alias("cell"), "key", "node", "fp", "size", "block").groupBy("cell").applyInPandas(compare, "src long, dst long")


def tile_links(fps: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: np.ndarray, radius: int, tile: int = 256) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between rows ``a`` and rows ``b`` of ``fps``."""
    ones = np.bitwise_count(fps).sum(1, dtype=np.int64)
    band = np.floor(np.log(np.maximum(size, 1)) / np.log(LENGTH_RATIO)).astype(np.int64)
    a, b = a[np.argsort(ones[a], kind="stable")], b[np.argsort(ones[b], kind="stable")]
    label, counts = {}, ones[b]
    for at in range(0, len(a), tile):
        rows = a[at : at + tile]
        lo, hi = np.searchsorted(counts, ones[rows[0]] - radius), np.searchsorted(counts, ones[rows[-1]] + radius, "right")
        others = b[lo:hi]
        for start in range(0, len(others), 8192):
            part = others[start : start + 8192]
            apart = np.zeros((len(rows), len(part)), np.uint16)
            for k in range(fps.shape[1]):
                apart += np.bitwise_count(fps[rows, k][:, None] ^ fps[part, k][None, :])
            near = (apart <= radius) & (np.abs(band[rows, None] - band[None, part]) <= 1)
            for i in np.flatnonzero(near.any(1)).tolist():
                join(label, [int(rows[i]), *part[near[i]].tolist()])
    found = ((x, root_of(label, x)) for x in list(label))
    return [(int(nodes[x]), int(nodes[r])) for x, r in found if x != r]


def root_of(label: dict[int, int], x: int) -> int:
    while (up := label.setdefault(x, x)) != x:
        label[x] = label.setdefault(up, up)
        x = label[x]
    return x


def join(label: dict[int, int], rows: list[int]) -> None:
    """Makes ``rows`` one group of the union-find forest ``label``."""
    root = root_of(label, rows[0])
    for x in rows[1:]:
        label[root_of(label, x)] = root


def exact_links(docs: DataFrame, wide: DataFrame, words_in_shingle: int, least: float) -> DataFrame:
    """``(src, dst)``: links that join the nodes of ``wide`` as all links of similarity ``least`` or more among candidates do.

    ``docs (id, mark, text)`` holds the texts. Candidates share a key and are near each other by fingerprint. First each
    node is compared with one hub, that of the most keys they share, which joins most of a large group in linear work.
    Then only keys with nodes of several groups go on, and there only pairs of different groups are compared.
    """
    _, members = buckets(wide)
    members = written(members.select("key", "hub", "node"))
    own = written(wide.join(members.select("node").distinct(), "node", "left_semi").select("node", "fp", "size", "first.id", "first.mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(t, words_in_shingle).tobytes() for t in values(b.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sets], ["node", "fp", "size", "set"])

    sets = docs.join(beside(own), ["id", "mark"]).select("node", "fp", "size", "text").mapInArrow(run, "node long, fp binary, size long, set binary")
    sets = written(sets.dropDuplicates(["node"]))
    star = written(star_links(members, sets, least))
    crossed = crossing_links(members, sets, connected_components(star), least)
    return star.unionByName(crossed)


def blocks_of(count: Column, size: Column) -> Column:
    """How many blocks ``count`` texts of ``size`` bytes make."""
    return F.greatest(F.ceil(count / TEXTS_A_BLOCK), F.ceil(size / BYTES_A_BLOCK), F.lit(1)).cast("int")


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def star_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links of each node with the hub that it shares most keys with; the hub's text goes to each block of its nodes."""
    votes = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    pairs = written(votes.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")))
    sizes = sets.select("node", (8 * F.col("size") + 64).alias("bytes"))
    groups = pairs.join(sizes, "node").groupBy("hub").agg(blocks_of(F.count("*"), F.sum("bytes")).alias("blocks"))
    bins = max(1, -(-(pairs.join(sizes, "node").agg(F.sum("bytes")).first()[0] or 0) // BYTES_A_BLOCK))
    nodes = pairs.join(groups, "hub").select("node", "hub", block_of(F.col("blocks")).alias("block"), "blocks")
    hubs = groups.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks")
    cell = F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("hub"), F.lit(bins)).alias("of"), F.lit(-1).alias("block"))).otherwise(F.struct(F.col("hub").alias("of"), "block"))
    rows = nodes.unionByName(hubs).join(sets.select("node", "set"), "node").select(cell.alias("cell"), "node", "hub", "set")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for hub, part in pdf.groupby("hub", sort=False):
            found = [np.frombuffer(x, np.uint64) for x in part["set"]]
            nodes = part["node"].tolist()
            home = found[nodes.index(hub)]
            out += [(hub, n) for n, x in zip(nodes, found, strict=True) if n != hub and alike(home, x, least)]
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return rows.groupBy("cell").applyInPandas(compare, "src long, dst long")


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets have a similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def crossing_links(members: DataFrame, sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links between nodes that share a key but are of different groups ``roots (node, root)``.

    Of a key's groups the largest is cut into blocks, and so are all others together (the rest); a block of the one meets a
    block of the other, and the rest meets itself. Small keys share tasks.
    """
    rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = rooted.join(sets.select("node", (8 * F.col("size") + 64).alias("bytes")), "node")
    held = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max_by(F.struct("root", "n", "bytes"), F.struct("n", -F.col("root")))
    keys = held.groupBy("key").agg(F.count("*").alias("groups"), main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("groups > 1")
    keys = written(keys.select("key", F.col("main.root").alias("main"), "n", "bytes", blocks_of(F.col("main.n"), F.col("main.bytes")).alias("most"), blocks_of(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others")))
    small = (F.col("most") == 1) & (F.col("others") == 1)
    bins = max(1, -(-(keys.where(small).agg(F.sum("bytes")).first()[0] or 0) // BYTES_A_BLOCK))
    rows = rooted.select("key", "node", "root").join(keys.select("key", "main", "most", "others"), "key").withColumn("rest", F.col("root") != F.col("main"))
    rows = rows.withColumn("block", block_of(F.when(F.col("rest"), F.col("others")).otherwise(F.col("most"))))

    def cell(of: Column, kind: str, low: Column, high: Column) -> Column:
        return F.struct(of.alias("of"), F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"))

    block, other, zero = F.col("block"), F.col("other"), F.lit(0)
    each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    alone = rows.where(small).select(cell(F.pmod(F.xxhash64("key"), F.lit(bins)), "small", zero, zero).alias("cell"), "key", "node", "root", "block", "rest")
    large = rows.where(~small)
    ours = large.where(~F.col("rest")).withColumn("other", each("others")).select(cell(F.col("key"), "cross", block, other).alias("cell"), "key", "node", "root", "block", "rest")
    theirs = large.where("rest").withColumn("other", each("most")).select(cell(F.col("key"), "cross", other, block).alias("cell"), "key", "node", "root", "block", "rest")
    among = large.where("rest").withColumn("other", each("others")).select(cell(F.col("key"), "rest", F.least(block, other), F.greatest(block, other)).alias("cell"), "key", "node", "root", "block", "rest")
    every = alone.unionByName(ours).unionByName(theirs).unionByName(among).join(sets, "node").select("cell", "key", "node", "root", "block", "rest", "fp", "set")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, low, high = (pdf["cell"].iloc[0][k] for k in ("kind", "low", "high"))
        out: list[tuple[int, int]] = []
        for _, part in pdf.groupby("key", sort=False):
            side = part["rest"].to_numpy(int) if kind == "cross" else part["block"].to_numpy() if kind == "rest" and low != high else None
            fps = np.frombuffer(b"".join(part["fp"]), np.uint64).reshape(len(part), -1)
            found = [np.frombuffer(x, np.uint64) for x in part["set"]]
            out += verified_links(fps, found, part["node"].to_numpy(np.int64), part["root"].to_numpy(np.int64), side, least)
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return every.groupBy("cell").applyInPandas(compare, "src long, dst long")


def verified_links(fps: np.ndarray, sets: list[np.ndarray], nodes: np.ndarray, roots: np.ndarray, side: np.ndarray | None, least: float, tile: int = 256) -> list[tuple[int, int]]:
    """Links that join the texts as all pairs of similarity ``least`` or more do, those with one root being joined already;
    between sides only, where given.

    Candidates are found by tiles of fingerprints in order of population count; tiles whose counts differ by more than
    the radius are skipped.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    label = np.unique(roots, return_inverse=True)[1].ravel()
    ones = np.bitwise_count(fps).sum(1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    widest = max(CANDIDATE_RADIUS, SHORT_RADIUS)
    out = []
    for at in range(0, n, tile):
        rows = order[at : at + tile]
        others = order[at : np.searchsorted(ones[order], ones[rows[-1]] + widest, "right")]  # earlier ones were compared
        apart = np.zeros((len(rows), len(others)), np.uint16)
        for k in range(fps.shape[1]):
            apart += np.bitwise_count(fps[rows, k][:, None] ^ fps[others, k][None, :])
        low, high = np.minimum(size[rows, None], size[None, others]), np.maximum(size[rows, None], size[None, others])
        near = (apart <= np.where(low <= SHORT, SHORT_RADIUS, CANDIDATE_RADIUS)) & (low >= least * high - 1e-9) & (label[rows, None] != label[None, others])
        if side is not None:
            near &= side[rows, None] != side[None, others]
        a, b = np.nonzero(near)
        nearest = np.argsort(apart[a, b], kind="stable")  # joined groups need no further comparison
        for i, j in zip(rows[a[nearest]].tolist(), others[b[nearest]].tolist(), strict=True):
            if label[i] != label[j] and alike(sets[i], sets[j], least):
                label[label == label[j]] = label[i]
                out.append((int(nodes[i]), int(nodes[j])))
    return out


NO_ID = -(1 << 63)  # stands for a null id


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``(id, mark, text)``: a row's id and the hash of its text name it."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))


def shingled(texts: DataFrame, words_in_shingle: int, exact: bool) -> DataFrame:
    """``(node, fp, same, size, keys, first)``: a node for all ``texts`` with one fingerprint and, if ``exact``, the same shingles.

    ``first`` is the least ``(no_id, id, mark)`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t in values(b.column(2)):
                hashes = shingle_set(t, words_in_shingle)
                made.append((wide_bits(hashes), len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()) if exact else None, minima(hashes).view(np.int64) if len(hashes) else None))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "mark", "fp", "size", "same", "keys"])

    marked = texts.mapInArrow(run, "id long, mark long, fp binary, size long, same binary, keys array<long>")
    order = F.struct((F.col("id") == NO_ID).alias("no_id"), "id", "mark")
    wide = marked.groupBy("fp", "same").agg(F.max("size").alias("size"), F.any_value("keys").alias("keys"), F.min(order).alias("first"))
    return written(wide.withColumn("node", F.monotonically_increasing_id()))


def representatives(docs: DataFrame, radius: int = WIDE_RADIUS, words_in_shingle: int = 5, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of similar texts does: that of the smallest doc_id.

    Groups are what links join: with ``least``, those of two texts whose shingles, with repeats, are that similar, found
    among candidates by keys and fingerprints and compared exactly (by hashes of 64 bits); without, those of ``radius`` or
    fewer differing bits between texts of like length that share a key. Of rows equal in doc_id and text one stays. Null
    and blank texts are a group; a null doc_id gives way to any other. Texts are read whole. An empty table gives no rows.
    """
    texts = keyed_texts(docs)
    wide = shingled(texts, words_in_shingle, least is not None)
    found = similar_links(wide, radius) if least is None else exact_links(texts, wide, words_in_shingle, least)
    roots = connected_components(found)
    stay = wide.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    stay = written(stay.select("first.id", "first.mark"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"))
    # The join and the window share one partitioning by key, so a text is shuffled once.
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy("id"))
    return rows.join(stay, ["id", "mark"], "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
