"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, by weights learned from labelled pages:
how much more often a word in such a container, or such a tag, stands inside the labelled content than outside. One
linear scan finds the contiguous run of highest score, the region; its blocks are the text. The labels (article and main
elements) are no input of what is learned: each page teaches once as it is and once with them shown as plain divisions.

A container inside the region (an advert between two paragraphs) is left out if what labelled pages taught about its
element, classes, id and role adds up to less than nothing. Before anything is learned a few names have a score, which
evidence outweighs. A container that encloses the region is never left out, whatever it is called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, values

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]|=(?!\s*["']))*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACES = re.compile(r"\s+")

#: Elements that flow inside a block.
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose names tell where a word stands.
CONTAINERS = set("html head body div section article main nav header footer aside form ul ol dl table td th figure details dialog menu fieldset address".split())
#: Elements without readable text, skipped with all they hold; the first lot runs to the page's end if it isn't closed.
RAW_TO_END = set("script style noscript template textarea title iframe".split())
RAW = RAW_TO_END | set("svg object select datalist button canvas audio video".split())
#: Scores of words and tags before anything is learned, and how many observations they count as.
WORD, TAG, BELIEF = 1.0, -3.0, 8.0
#: Elements of running text, and the first score of their tags.
PROSE, TAG_OF_PROSE = set("p br h1 h2 h3 h4 h5 h6 blockquote pre".split()), -0.2
#: Scores of containers before anything is learned: by element, and by a whole word of class, id or role. All others
#: have none. What pages teach outweighs them after ``BELIEF`` containers.
LABELS = dict.fromkeys("<nav> <footer> <aside> <form> <menu> <dialog> <head> <header>".split(), -2.0) | dict.fromkeys(
    "ad ads advert advertisement sponsored promo banner cookie-notice sidebar nav navigation menu breadcrumb breadcrumbs footer comments respond share related newsletter".split(), -2.0
)
#: Containers that hold content by definition.
CONTENT = ("article", "main")


@dataclass
class Container:
    """An element that tells where words stand: from token ``first`` to before token ``end``."""

    name: str
    labels: tuple[str, ...]  # what its score goes by
    parent: int
    inside: bool  # in an element that labels content; fitting alone reads it
    label: bool  # such an element itself
    first: int
    end: int = 1 << 62


@dataclass
class Token:
    """A tag, or a stretch of text with ``words`` words between two tags."""

    kind: str  # what weights go by
    words: int = 0  # 0 for a tag
    text: str = ""
    home: int = -1  # the innermost container
    block: int = 0  # texts of one block share it


def names(attributes: str) -> list[str]:
    """The words of class, id and role in lower case, without digits, each once and in order."""
    found = {re.sub(r"\d+", "", x) for n in NAMES.findall(attributes) for x in n.strip("\"'").lower().split()}
    return sorted(found - {""})


def tokens(html: str, blind: bool = False) -> tuple[list[Token], list[Container]]:
    """The tokens and containers of a whole page; unclosed and stray tags do no harm. ``blind`` shows what labels content as a division."""
    out: list[Token] = []
    every: list[Container] = []
    stack: list[int] = []  # containers that are open
    at, block, linked = 0, 0, False

    def words(text: str) -> None:
        text = SPACES.sub(" ", unescape(text))
        if text:
            home = stack[-1] if stack else -1
            key = f"{every[home].name}.{'.'.join(every[home].labels)}" if stack else ""
            out.append(Token(f"word {key}{' a' * linked}", len(text.split()), text, home, block))

    def close(depth: int) -> None:
        for k in stack[depth:]:
            every[k].end = len(out)
        del stack[depth:]

    find = TOKEN.search
    while m := find(html, at):
        words(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closes = m[2].lower(), bool(m[1])
        label = name in CONTENT
        name = "div" if blind and label else name
        if name in RAW and not closes:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html) if name in RAW_TO_END else at
            block += name not in INLINE
            continue
        if name == "a":
            linked = not closes
        if name not in INLINE:
            block += 1
            linked = False
            if stack and every[stack[-1]].name == "p":  # ends at any other block
                close(len(stack) - 1)
        elif name == "br":
            out.append(Token("tag br", 0, " ", stack[-1] if stack else -1, block))
            continue
        labels: list[str] = []
        if name in CONTAINERS or name == "p":
            if closes:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if every[stack[k]].name == name), None)
                if depth is not None:
                    close(depth)
            elif not m[3].endswith("/"):
                labels = names(m[3])
                inside = bool(stack) and every[stack[-1]].inside
                if f"<{name}>" in LABELS and not (name == "header" and inside and not blind):
                    labels.insert(0, f"<{name}>")
                if name != "p" or labels:
                    every.append(Container(name, tuple(labels), stack[-1] if stack else -1, inside or label, label, len(out)))
                    stack.append(len(every) - 1)
        home = stack[-1] if stack else -1
        out.append(Token(f"tag {'/' * closes}{name}{'.' * bool(labels)}{'.'.join(labels)}", 0, "", home, block))
    words(html[at:])
    return out, every


def first_score(kind: str) -> float:
    """The score of a word or tag of which nothing is known."""
    return WORD if kind.startswith("word") else TAG_OF_PROSE if kind.removeprefix("tag ").removeprefix("/") in PROSE else TAG


@dataclass
class Weights:
    """Scores of words and tags by kind, and of containers by label."""

    by_kind: dict[str, float] = field(default_factory=dict)
    by_label: dict[str, float] = field(default_factory=lambda: dict(LABELS))

    def score(self, t: Token) -> float:
        if t.words:
            return t.words * self.by_kind.get(t.kind, WORD)
        return self.by_kind.get(t.kind, first_score(t.kind)) if t.kind.startswith("tag") else 0.0

    def outside(self, containers: list[Container], first: int, end: int) -> list[bool]:
        """Of each container, whether it or one around it is no content; those that enclose the tokens from ``first`` to before ``end`` are."""
        out: list[bool] = []
        for c in containers:
            away = c.name not in CONTENT and not (c.first <= first and end <= c.end) and sum(self.by_label.get(x, 0.0) for x in c.labels) < 0
            out.append(away or (c.parent >= 0 and out[c.parent]))
        return out

    @classmethod
    def fit(cls, pages: list[str]) -> Weights:
        """From pages that label their content by an article or main element; others teach nothing."""
        parsed = [tokens(h, blind) for h in pages for blind in (False, True)]
        labelled = [(found, every) for found, every in parsed if any(t.words and t.home >= 0 and every[t.home].inside for t in found)]
        held: Counter[str] = Counter()
        apart: Counter[str] = Counter()
        for _, containers in labelled:
            around = {k for c in containers if c.label for k in ancestors(containers, c.parent)}
            for k, c in enumerate(containers):
                if k not in around and not c.label:
                    (held if c.inside else apart).update(c.labels)
        by_label = dict(LABELS)
        for label in held.keys() | apart.keys():
            n = held[label] + apart[label]
            odds = math.log((held[label] + 1) / (apart[label] + 1))
            by_label[label] = (BELIEF * LABELS.get(label, 0.0) + n * max(min(odds, 6.0), -6.0)) / (BELIEF + n)
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for found, containers in labelled:
            away = cls({}, by_label).outside(containers, 0, 0)
            content = [c.inside and not a for c, a in zip(containers, away, strict=True)] + [False]
            for t in found:
                if t.kind != "word " or t.words:
                    (inside if content[t.home] else outside)[t.kind] += max(1, t.words)
        by_kind = {}
        for kind in inside.keys() | outside.keys():
            base = first_score(kind)
            odds = math.log((inside[kind] + 1) / (outside[kind] + 1))
            n = inside[kind] + outside[kind]
            learned = min(odds, 2.0) if kind.startswith("word") else min(max(odds - 1.0, TAG), -0.1)  # no tag counts for content, nor more against it than an unknown one
            by_kind[kind] = (BELIEF * base + n * max(learned, -6.0)) / (BELIEF + n)
        return cls(by_kind, by_label)


def ancestors(containers: list[Container], k: int) -> Iterator[int]:
    """``k`` and the containers around it."""
    while k >= 0:
        yield k
        k = containers[k].parent


def best_run(scores: list[float]) -> tuple[int, int]:
    """``(start, end)`` of the contiguous run with the greatest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def main_text(html: str | None, weights: Weights) -> str:
    """The text of a page's best region: a line for each block, white space in it made one space."""
    found, containers = tokens(html or "")
    scores = [weights.score(t) for t in found]
    start, end = best_run(scores)
    if start == end:
        return ""
    # What encloses the best run is never left out. The run is sought again with the words of what is left out against it,
    # but not its tags.
    away = [*weights.outside(containers, start, end), False]
    again = best_run([-t.words * WORD if away[t.home] else s for t, s in zip(found, scores, strict=True)])
    if again[0] < again[1]:
        start, end = again
    # A region that begins or ends inside a block takes the whole block.
    first, last = found[start].block, found[end - 1].block
    blocks: dict[int, list[str]] = {}
    for t in found:
        if first <= t.block <= last and t.text and not away[t.home]:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (SPACES.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def fit(pages: DataFrame, sample: int = 300) -> Weights:
    """Weights from ``sample`` pages at most, the first by a hash of id and URL, of those with an article or main element."""
    return Weights.fit(few(pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")), sample))


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A null or empty html, or one without a positive region, gives an empty text. Repeated rows give repeated rows, and
    an empty table none.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = weights or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, model) for h in values(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
