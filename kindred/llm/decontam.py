"""Passages of a benchmark in documents, in DataFrame functions alone.

Item-sized windows of a document are fingerprinted by SimHash and joined to the items of that size on blocks of their
bits: two fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks at least, so the join finds every such
pair. Exact weighted-shingle similarity then verifies each.

Not every window of a corpus can be fingerprinted for every size of item, so windows are first narrowed without loss: one
of similarity t shares at least t of the item's n shingles, so its document holds one of any (1 - t) * n + 1 of them. Each
item's rarest serve as anchors, and in documents that hold one, only windows with enough places of the item's shingles,
wherever in the item these stand, can match. A window is compared with the items that made it a candidate.

An item of fewer words than a shingle is one shingle as a whole: the windows of similarity ``SIMILARITY`` are those of its
very words, which a join on the windows' hashes finds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 128 within which windows are candidates. At similarity 0.8 a ninth of the words may differ, so the angle's share
#: is acos(8 / 9) / pi = 0.15 at most: 19 bits are expected to differ, give or take 4.
RADIUS = 36
#: Widths of the blocks of either half, one more in all than ``RADIUS``. Item size and block together are a key.
BLOCKS = (4,) * 10 + (3,) * 8, (4,) * 7 + (3,) * 12
#: Words that a window may have for 16 bits to count them.
COUNTED = 60_000
#: Anchors are broadcast up to so many rows (about 40 bytes each); beyond, the join is left to a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(array: str) -> Column:
    """A hash of the ``SHINGLE`` words from each word on; the last few, of fewer words, match none of an item's."""
    return F.transform(array, lambda w, i: F.xxhash64(w, *(F.get(F.col(array), i + k) for k in range(1, SHINGLE))))


def shingles(array: str) -> Column:
    """The shingles of an array of at least ``SHINGLE`` words, as strings with repeats."""
    return F.transform(F.sequence(F.lit(1), F.size(array) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(F.col(array), i, SHINGLE), " "))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` made once however often it is looked at."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def simhash(array: str, seed: int) -> Column:
    """The 64-bit SimHash of an array's words: a bit is 1 if it is set in more than half of their hashes.

    Four counters of 16 bits share a number, so 16 sums count all bits; arrays too long for that are counted bit by bit.
    """
    size, zero, one = F.size(array), F.lit(0).cast("long"), F.lit(1).cast("long")

    def lanes(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(hashes, zero, lambda acc, h: acc + F.call_function("shiftright", h, k).bitwiseAND(F.lit(0x0001000100010001))))

    def count(sums: Column, b: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(sums, b % 16), 16 * F.floor(b / 16).cast("int")).bitwiseAND(0xFFFF)

    def fingerprint(ones: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, b: F.when(2 * ones(b) > size, acc.bitwiseOR(F.call_function("shiftleft", one, b))).otherwise(acc))

    def made(hashes: Column) -> Column:
        few = let(lanes(hashes), lambda sums: fingerprint(lambda b: count(sums, b)))
        many = fingerprint(lambda b: F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, b).bitwiseAND(1) == 1)))
        return F.when(size <= COUNTED, few).otherwise(many)

    return let(F.transform(array, lambda w: F.xxhash64(w, F.lit(seed))), made)


def block_values(low: Column, high: Column) -> list[Column]:
    """The blocks of a fingerprint in two halves."""
    out = []
    for half, widths in zip((low, high), BLOCKS, strict=True):
        at = 0
        for w in widths:
            out.append(F.shiftrightunsigned(half, at).bitwiseAND((1 << w) - 1).cast("int"))
            at += w
    return out


def block_keys(low: Column, high: Column) -> Column:
    """``RADIUS + 1`` numbers, each a block's place and value."""
    return F.array(*(16 * j + v for j, v in enumerate(block_values(low, high))))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays, an element's weight being how often it occurs."""

    def count(array: str, x: Column) -> Column:
        return F.size(F.filter(array, lambda y: y == x))

    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    simple = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(simple, F.size(F.array_intersect(a, b))).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, form, item_words, item_low, item_high, ours)`` of the items with any word; ``ours`` is their shingles' hashes."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("item_words")).where(F.size("item_words") >= 1).distinct()
    # The shingles' hashes, like all that lambdas below look up, are a written column, lest they be made again for each element.
    ours = F.slice(shingle_hashes("item_words"), F.lit(1), F.greatest(F.size("item_words") - (SHINGLE - 1), F.lit(1)))
    return written(rows.select("item_id", F.xxhash64("item_words").alias("form"), "item_words", simhash("item_words", 1).alias("item_low"), simhash("item_words", 2).alias("item_high"), ours.alias("ours")))


def short_leaks(keyed: DataFrame, short: DataFrame) -> DataFrame:
    """As ``leaks``, of documents ``(doc_id, mark, words)`` and items of fewer words than a shingle.

    Of a window and an item of one length and hash the words themselves are compared. Equal windows have equal
    fingerprints, so the distance is 0.
    """
    lengths = [r[0] for r in short.select(F.size("item_words")).distinct().collect()]  # under SHINGLE
    if not lengths:
        return keyed.limit(0).select("doc_id", "mark", F.lit(0).cast("long").alias("item_id"), *(F.lit(0).alias(c) for c in ("start", "n_words", "distance")), F.lit(1.0).alias("similarity"))
    sets = short.select("item_id", "item_words", F.size("item_words").alias("length"), F.get("ours", F.lit(0)).alias("hash"))
    if short.count() <= BROADCAST_ROWS:
        sets = F.broadcast(sets)

    def windows(n: int) -> Column:
        hashed = F.transform("words", lambda w, i: F.struct(F.lit(n).alias("length"), F.xxhash64(w, *(F.get(F.col("words"), i + k) for k in range(1, n))).alias("hash"), i.alias("start")))
        return F.slice(hashed, F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0)))

    each = keyed.select("doc_id", "mark", "words", F.explode(F.concat(*map(windows, lengths))).alias("w"))
    hits = each.select("doc_id", "mark", "w.length", "w.hash", "w.start", F.slice("words", F.col("w.start") + 1, F.col("w.length")).alias("window")).join(sets, ["length", "hash"])
    found = hits.where(F.col("window") == F.col("item_words")).groupBy("doc_id", "mark", "item_id").agg(F.min("start").alias("start"), F.max("length").alias("n_words"))
    return found.select("doc_id", "mark", "item_id", "start", "n_words", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))


def anchors(known: DataFrame, least: float) -> DataFrame:
    """``(hash, item_id, form)``: enough of each item's rarest shingles that a window of similarity ``least`` holds one."""
    rows = known.select("item_id", F.size("item_words").alias("length"), "form", F.posexplode(shingle_hashes("item_words")).alias("offset", "hash"))
    rows = rows.where(F.col("offset") <= F.col("length") - SHINGLE)
    own = rows.select("item_id", "form", "length", "hash").distinct()
    common = own.select("item_id", "hash").distinct().groupBy("hash").agg(F.count("*").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id", "form").orderBy("items", "hash"))
    enough = F.floor((1 - least) * (F.col("length") - SHINGLE + 1) + 1e-9) + 1
    kept = own.join(common, "hash").withColumn("rank", rank).where(F.col("rank") <= enough)
    return written(kept.select("hash", "item_id", "form"))


def starts(places: str, length: Column, least: float) -> Column:
    """Where windows of ``length`` words start that hold enough of the sorted ``places`` for similarity ``least``.

    A window that starts before the document has a negative start.
    """
    room = length - SHINGLE  # from a window's start to its last shingle
    need = F.greatest(F.ceil(least * (room + 1) - 1e-9), F.lit(1)).cast("int")
    runs = F.transform(F.slice(places, need, F.size(places)), lambda last, i: F.struct((last - room).alias("a"), F.get(F.col(places), i).alias("b")))
    runs = F.filter(runs, lambda r: r["a"] <= r["b"])
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"]))))


def candidates(windows: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Windows ``(doc_id, mark, at, length, low, high)`` with each item of that length within ``radius`` (at most ``RADIUS``) bits.

    A pair is given once, at the first block in which it agrees, with its ``distance``. Windows with a ``form`` are only
    compared with the items of that form.
    """
    blocks = known.select("item_id", "form", "item_low", "item_high", F.size("item_words").alias("length"), F.explode(block_keys(F.col("item_low"), F.col("item_high"))).alias("key"))
    if known.count() * (RADIUS + 1) <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    keyed = windows.withColumn("key", F.explode(block_keys(F.col("low"), F.col("high"))))
    low, high = F.col("low").bitwiseXOR(F.col("item_low")), F.col("high").bitwiseXOR(F.col("item_high"))
    first = F.array_position(F.transform(F.array(*block_values(low, high)), lambda v: v == 0), True) - 1
    distance = (F.bit_count(low) + F.bit_count(high)).cast("int")
    pairs = keyed.join(blocks, ["length", "key", *(["form"] if "form" in windows.columns else [])]).where((distance <= radius) & (first == F.floor(F.col("key") / 16)))
    return pairs.select("doc_id", "mark", "at", "length", "item_id", "form", distance.alias("distance"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, mark, item_id, start, n_words, distance, similarity)``: the best window for each document and item.

    ``start`` and ``n_words`` place the window in the document's words (runs of letters and digits), ``distance`` is in
    bits of 128, ``mark`` is xxhash64 of the text and tells rows with one doc_id apart. A window reaches over the
    document's ends no further than it has words. Of equally similar windows the earliest is given. Null and empty
    texts and items match nothing; an item under five words matches its very words. Repeated rows are reported once; an
    empty table on either side gives no rows.
    """
    every = items(benchmark)
    known = every.where(F.size("item_words") >= SHINGLE)
    marks = anchors(known, least)
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), words(F.col("text")).alias("words"))
    hits = keyed.select("doc_id", "mark", F.explode(shingle_hashes("words")).alias("hash")).join(marks, "hash")
    # Only documents with an anchor are read again.
    held = written(hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("item_id", "form")).alias("held")))
    found = keyed.withColumnsRenamed({"doc_id": "id", "mark": "own"}).join(held, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")))
    texts = written(found.select("doc_id", "mark", "words", shingle_hashes("words").alias("hashes"), "held").dropDuplicates(["doc_id", "mark"]))

    pairs = texts.select("doc_id", "mark", "hashes", F.explode("held").alias("item")).select("doc_id", "mark", "hashes", F.col("item.item_id").alias("item"), "item.form")
    pairs = pairs.join(known.withColumnRenamed("form", "own"), F.col("item").eqNullSafe(F.col("item_id")) & (F.col("form") == F.col("own")))
    length = F.size("item_words")
    places = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("ours", h), i)), lambda i: i.isNotNull())
    places = pairs.select("doc_id", "mark", "form", length.alias("length"), places.alias("places"))
    windows = places.select("doc_id", "mark", "form", "length", F.explode(starts("places", F.col("length"), least)).alias("at"))
    windows = windows.groupBy("doc_id", "mark", "length", "at").agg(F.collect_set("form").alias("forms"))  # fingerprinted once

    def cut(rows: DataFrame) -> DataFrame:
        """``rows (doc_id, mark, at, length)`` with their words as ``window``."""
        own = texts.select(F.col("doc_id").alias("id"), F.col("mark").alias("own"), "words")
        rows = rows.join(own, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")))
        window = F.slice("words", F.greatest("at", F.lit(0)) + 1, F.col("length") + F.least("at", F.lit(0)))
        return rows.withColumn("window", window).drop("id", "own", "words").where(F.size("window") >= SHINGLE)

    windows = written(cut(windows).select("doc_id", "mark", "at", "length", "forms", simhash("window", 1).alias("low"), simhash("window", 2).alias("high")))
    near = cut(candidates(windows.withColumn("form", F.explode("forms")).drop("forms"), known))
    near = near.withColumnsRenamed({"item_id": "item", "form": "item_form"}).join(known, F.col("item").eqNullSafe(F.col("item_id")) & (F.col("item_form") == F.col("form")))
    near = near.withColumn("a", shingles("window")).withColumn("b", shingles("item_words"))
    start = F.greatest("at", F.lit(0)).alias("start")
    scored = near.select("doc_id", "mark", "item_id", start, F.size("window").alias("n_words"), "distance", similarity("a", "b").alias("similarity")).where(F.col("similarity") >= least - 1e-9)
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start"), "n_words", -F.col("distance")))
    found = scored.groupBy("doc_id", "mark", "item_id").agg(best.alias("best")).select("doc_id", "mark", "item_id", "best.*")
    return found.unionByName(short_leaks(keyed, every.where(F.size("item_words") < SHINGLE)))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``, with their columns and repeats.

    Null and empty texts hold none, and stay. An empty benchmark leaves every row, an empty table none.
    """
    gone = written(leaks(docs, benchmark, least).select("doc_id", "mark").distinct())
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text")) == F.col("mark")), "left_anti").select("row.*")
