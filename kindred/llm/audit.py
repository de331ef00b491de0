"""What filters remove, and how that depends on the order they are applied in.

All orders of the filters form a trie. It is walked depth first: a state's survivors are a persisted DataFrame, from which
each next filter makes the next state's. Prefixes that hold the same filters in another order have the same survivors, so a
state is made once and shared (32 states for five filters, against 326 nodes of the trie), and one pass over its survivors
counts what every filter that may come next removes there. A state's survivors are given up when all states behind it are
counted.
"""

from __future__ import annotations

import itertools
from functools import reduce
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The filters of ``failures`` by letter.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, good, toxic, fails)`` for every row of ``docs``; ``fails`` has a bit for each of ``FILTERS``, A the lowest.

    A: under 200 words. B: distinct words are under 50 % of them. C: capitals are over 3 % of code points. D: holds one of
    ``#$%&*|``. E: a smaller doc_id has the same text. Null texts are empty ones, a null lang is the part ``''``. A null
    doc_id is smaller than none and has none smaller. A document is good or toxic if any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    tests = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    bits = reduce(lambda a, b: a + b, (F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)))
    rows = written(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits")))
    # Each text's first id is one row, and meets its own document alone: copies aren't joined by their text.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("is_first"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull())
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    joined = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    return joined.select("part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")), (F.col("bits") + F.when(later, 1 << 4).otherwise(0)).alias("fails"))


def failing(k: int) -> Column:
    return F.col("fails").bitwiseAND(1 << k) != 0


class Trie:
    """The walk over all orders of ``n`` filters on ``rows (part, good, toxic, fails)``."""

    def __init__(self, rows: DataFrame, n: int) -> None:
        self.rows, self.n, self.edges = rows, n, {}

    def walk(self, state: int = 0, survivors: DataFrame | None = None) -> None:
        """Counts the edges out of ``state``, a set of applied filters as bits, and of all states behind it that are new."""
        if state in self.edges or state == (1 << self.n) - 1:
            return
        survivors = self.rows if survivors is None else survivors
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        self.edges[state] = written(self.counted(survivors)).withColumn("state", F.lit(state))
        for k in (k for k in range(self.n) if not state >> k & 1):
            self.walk(state | 1 << k, survivors.where(~failing(k)))
        survivors.unpersist()

    def counted(self, survivors: DataFrame) -> DataFrame:
        """``(part, n, removed, good, toxic)``: a row for each part; the lists have what each filter would remove.

        The same expression for every state, so that its code is made once; a filter already applied removes nothing.
        """
        gone = [failing(k).cast("long") for k in range(self.n)]
        sums = (F.array(*(F.sum(g * w) for g in gone)).alias(name) for name, w in (("removed", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic"))))
        return survivors.groupBy("part").agg(F.count("*").alias("n"), *sums).coalesce(1)

    def counts(self) -> DataFrame:
        """``(part, state, filter, kept, removed, good_lost, toxic_lost)``: a row for each part and edge that was walked."""
        states = reduce(DataFrame.unionByName, self.edges.values())
        each = F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("filter", "e")
        rows = states.select("part", "state", "n", each).where(F.expr("shiftright(state, filter)").bitwiseAND(1) == 0)
        return rows.select("part", "state", "filter", (F.col("n") - F.col("e.removed")).alias("kept"), F.col("e.removed").alias("removed"), F.col("e.good").alias("good_lost"), F.col("e.toxic").alias("toxic_lost"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    One row, zeros included, for each part, order of ``FILTERS`` and step; see ``failures`` for filters, nulls and
    repeated ids (each row counts). ``shapley`` is what the step's filter removes, summed over all orders. Very long texts
    are judged whole. An empty table gives no rows.
    """
    rows = written(failures(docs, labels))
    n = len(FILTERS)
    trie = Trie(rows, n)
    trie.walk()
    edges = written(trie.counts())
    # An edge lies on as many orders as there are orders of the filters before it and of those after it.
    orders = reduce(lambda x, s: x.when(F.col("state") == s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())), range(1, (1 << n) - 1), F.when(F.col("state") == 0, factorial(n - 1)))
    shapley = edges.groupBy("part", "filter").agg(F.sum(orders * F.col("removed")).alias("shapley"))
    alone = reduce(lambda a, b: a.when(F.col("fails") == 1 << b, b), range(1, n), F.when(F.col("fails") == 1, 0))
    of_filters = rows.groupBy("part").agg(*(F.sum(failing(k).cast("long")).alias(f"all{k}") for k in range(n)), *(F.sum((alone == k).cast("long")).alias(f"alone{k}") for k in range(n)))

    steps = [("".join(order), at + 1, sum(1 << FILTERS.index(x) for x in order[:at]), FILTERS.index(f)) for order in itertools.permutations(FILTERS) for at, f in enumerate(order)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")  # as many as orders and filters
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("filter"), F.col(f"all{k}").alias("all"), F.coalesce(F.col(f"alone{k}"), F.lit(0)).alias("alone")) for k in range(n))))
    places = of_filters.select("part", each.alias("of")).select("part", "of.*").join(F.broadcast(steps), "filter")
    counts = places.join(edges, ["part", "state", "filter"], "left").join(shapley, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")  # noqa: E731  a part of which nothing is left has no edge
    return counts.select(
        "part",
        "filter_order",
        "step",
        *(zero(F.col(c)).alias(c) for c in ("kept", "removed")),
        (F.col("all") - zero(F.col("removed"))).cast("long").alias("redundant"),
        F.col("alone").cast("long").alias("unique_fails"),
        *(zero(F.col(c)).alias(c) for c in ("good_lost", "toxic_lost", "shapley")),
    )
