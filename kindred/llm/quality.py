"""Quality by weak supervision.

Rules read a text's figures and vote for good, against it, or abstain; each measure has a strict rule, which also objects
to some good texts, and a lenient one that only objects to what is far off. Expectation-maximisation over the counts of
vote patterns estimates how each rule votes on good and on bad texts. Votes then add up to a posterior probability of
good, so a rule that is often wrong is overruled, and many weak signs count without any objection. Only counts of
patterns ever reach the driver.
"""

from __future__ import annotations

import operator
import re
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\x0c"
MEASURES = (
    *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_distinct_words"),
    *("n_symbol_words", "n_emphatic_words", "n_adjacent_words", "n_capitals", "n_letters"),
)
LETTER = re.compile(r"[^\W\d_]")
SYMBOL = re.compile(rf"[{re.escape(SYMBOLS)}]".encode())
CAPITALS, LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()
REPEAT_WINDOW = 8


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words covered by a window of ``window`` words that occurs twice or more in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    sums = np.zeros(n, np.uint64)
    for k in range(window):
        sums = (sums * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[k : k + n] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
        sums ^= sums >> np.uint64(29)
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    if not same.any():
        return 0
    some = np.zeros(n, bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    # Equal sums only name candidates; the words themselves decide.
    seen: dict[bytes, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(some).tolist():
        first = seen.setdefault(ids[i : i + window].tobytes(), i)
        if first != i:
            for at in (first, i):
                hit[at] += 1
                hit[at + window] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of a whole text; all are 0 for a null."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, seen = 0, set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    distinct, symbols = set(words), sum(map(text.count, SYMBOLS))
    wordy = {w for w in distinct if LETTER.search(w.decode("utf-8", "replace"))}
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        symbols,
        dup,
        repeated_words(words),
        lines,
        len(words) if len(wordy) == len(distinct) else sum(w in wordy for w in words),
        len(distinct),
        sum(SYMBOL.search(w) is not None for w in words) if symbols else 0,
        sum(w.endswith((b"!!", b"??")) for w in words) if b"!!" in raw or b"??" in raw else 0,
        sum(map(operator.eq, words, words[1:])),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(raw) - len(raw.translate(None, LETTERS)),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` as a column ``row``, and ``MEASURES`` beside it; only texts go to Python, and only figures come back."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def figures(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES), dtype="int64")

    return docs.select(F.struct("*").alias("row"), figures("text").alias("m")).select("row", "m.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Each measure's good, strict and lenient limits: better than the first is a vote for good, beyond the second an objection
#: of the strict rule, beyond the third one of the lenient rule as well. Measures grow as texts get worse.
LIMITS = (
    ("words too few", -50, -40, -10),
    ("words too long or too short", 1.0, 1.1, 2.0),
    ("symbols a character", 0.002, 0.01, 0.1),
    ("words with a symbol", 0.01, 0.05, 0.3),
    ("words without a letter", 0.01, 0.03, 0.2),
    ("lines that repeat", 0.0, 0.1, 0.5),
    ("words in repeated windows", 0.01, 0.05, 0.3),
    ("words equal to the one before", 0.01, 0.03, 0.2),
    ("words with doubled marks", 0.005, 0.02, 0.2),
    ("capitals a letter", 0.04, 0.1, 0.4),
    ("distinct words too few", -0.6, -0.5, -0.2),
)
#: Mean lengths of a word that are no sign of anything.
WORD_LENGTHS = 4.2, 6.5
#: Votes of the strict and the lenient rule by level: good, in between, beyond the strict limit, beyond both.
VOTES = np.array([(1, 0), (0, 0), (-1, 0), (-1, -1)])


def levels() -> list[Column]:
    """Each measure's level from 0 to 3, an index of ``VOTES``."""
    n, chars, lines, letters = (F.greatest(F.col(k), F.lit(1)) for k in ("n_words", "word_chars", "n_lines", "n_letters"))
    length = chars / n
    found = (
        -n,
        F.greatest(length / WORD_LENGTHS[1], WORD_LENGTHS[0] / length),
        F.col("n_symbols") / chars,
        F.col("n_symbol_words") / n,
        1 - F.col("n_letter_words") / n,
        F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / n,
        F.col("n_adjacent_words") / n,
        F.col("n_emphatic_words") / n,
        F.col("n_capitals") / letters,
        -F.col("n_distinct_words") / n,
    )
    return [F.when(x > lenient, 3).when(x > strict, 2).when(x > good, 1).otherwise(0) for x, (_, good, strict, lenient) in zip(found, LIMITS, strict=True)]


def pattern() -> Column:
    """All levels as one number, two bits a measure."""
    return sum((level * 4**k for k, level in enumerate(levels())), F.lit(0))


def votes_of(codes: np.ndarray) -> np.ndarray:
    """The rules' votes (patterns x rules) of numbers that ``pattern`` gives."""
    every = (np.asarray(codes, np.int64)[:, None] >> (2 * np.arange(len(LIMITS)))) & 3
    return VOTES[every].reshape(len(every), 2 * len(LIMITS))


#: How often a rule is taken to object, abstain and agree before any vote is seen: on bad texts and on good ones, for rules
#: that vote either way and for lenient ones.
BELIEFS = np.array([[(0.35, 0.25, 0.40), (0.20, 0.75, 0.05)], [(0.05, 0.15, 0.80), (0.01, 0.94, 0.05)]])
LENIENT = np.arange(2 * len(LIMITS)) % 2 == 1


@dataclass
class LabelModel:
    """Votes as noisy views of one hidden label, independent given it.

    ``rates[y, rule, vote + 1]`` is how often a rule votes so on a text of label ``y`` (0 bad, 1 good).
    """

    prior: float
    rates: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, belief: float = 20.0, lenient: np.ndarray | None = None) -> LabelModel:
        """Expectation-maximisation, begun from ``BELIEFS`` that weigh as much as ``belief`` texts.

        They tell the two labels apart, and keep rates off zero. ``lenient`` marks the rules that never vote for good.
        """
        before = np.where((np.zeros(patterns.shape[1], bool) if lenient is None else lenient)[:, None], BELIEFS[:, 1:], BELIEFS[:, :1])
        model = cls(0.8, before)
        for _ in range(rounds if len(counts) else 0):
            good = model.posterior(patterns)
            mass = np.stack([(1 - good) * counts, good * counts])
            sums = np.zeros_like(before)
            for at in range(0, len(counts), CHUNK):
                for v in (-1, 0, 1):
                    sums[:, :, v + 1] += mass[:, at : at + CHUNK] @ (patterns[at : at + CHUNK] == v)
            sums += belief * before
            model = cls(float((mass[1].sum() + 0.8 * belief) / (counts.sum() + belief)), sums / sums.sum(-1, keepdims=True))
        return model

    def weights(self) -> np.ndarray:
        """What each rule's votes -1, 0 and 1 add to the logarithm of the odds of good."""
        return np.log(self.rates[1]) - np.log(self.rates[0])

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good for each pattern."""
        odds, w = np.full(len(patterns), np.log(self.prior / (1 - self.prior))), self.weights()
        for at in range(0, len(patterns), CHUNK):
            for v in (-1, 0, 1):
                odds[at : at + CHUNK] += (patterns[at : at + CHUNK] == v) @ w[:, v + 1]
        return 1 / (1 + np.exp(np.clip(-odds, -700, 700)))


#: Patterns that are spread out at once in fitting.
CHUNK = 100_000


def fitted(rows: DataFrame) -> LabelModel:
    """The model of measured ``rows`` with a ``pattern``.

    Only counts of patterns reach the driver: at most 4 ** 11 rows of two numbers (50 MB), a few hundred in practice.
    """
    tally = rows.groupBy("pattern").count().toPandas()
    return LabelModel.fit(votes_of(tally["pattern"].to_numpy()), tally["count"].to_numpy(float), lenient=LENIENT)


def posterior(model: LabelModel) -> Column:
    """The probability of good of a row with a ``pattern``, as an expression: levels add up, so nothing is joined."""
    w = model.weights().reshape(len(LIMITS), 2, 3)
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for k, (strict, lenient) in enumerate(w):
        level = F.shiftright("pattern", 2 * k).bitwiseAND(3)
        by_level = [float(strict[a + 1] + lenient[b + 1]) for a, b in VOTES]
        odds += F.when(level == 0, by_level[0]).when(level == 1, by_level[1]).when(level == 2, by_level[2]).otherwise(by_level[3])
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)`` by row.

    ``quality`` is the posterior probability of good, and ``kept`` is 0.5 or more of it in a text that passes the base
    check. Null and blank texts fail the base check. Very long texts are measured whole. Repeated rows are judged alike,
    each counted; a pattern's probability depends on counts alone, so ties can't differ. An empty table gives no rows.
    """
    rows = measured(docs.select(F.col("doc_id").cast("long"), "text")).select("row.doc_id", *MEASURES)
    rows = written(rows.withColumn("pattern", pattern()).select("doc_id", *MEASURES[:5], "pattern", base_failed().alias("base_failed")))
    scored = rows.withColumn("quality", posterior(fitted(rows)))
    return scored.select("doc_id", *MEASURES[:5], "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with its columns and repeats.

    Texts are measured once: rows that pass the base check are written beside their pattern, and then only filtered. All
    rows count for the fit. Null and blank texts go. An empty table gives no rows.
    """
    rows = measured(docs).withColumn("pattern", pattern()).select(F.when(~base_failed(), F.col("row")).alias("row"), "pattern")
    rows = written(rows)
    return rows.where(F.col("row").isNotNull() & (posterior(fitted(rows)) >= 0.5)).select("row.*")
