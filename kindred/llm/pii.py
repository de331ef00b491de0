"""Personal data by anchors.

One Aho-Corasick automaton finds at-signs, scheme marks, plus signs, digits and cues of identifiers in a text. Each anchor
has a parser that expands it to both sides, as far as the characters of its kind go, and validates what it has found.
A parser looks at no character twice but at its borders, so a text is read in linear time.

Base spans are those of four plain patterns. The parsers add spans that those patterns drop or cannot know: a card number
or phone number that runs into further digits, an address written with "[at]", a login in an address with a scheme, and
numbers of accounts after a cue, validated by their check digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order spans are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "login", "account", "national_id")
BASE = KINDS[:4]
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTERS_DIGITS = LOCAL - frozenset("._%+-")
DIGITS = "0123456789"

# What follows an anchor. No part of a pattern can also be matched by what comes after it, so nothing is tried twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
DIALLED = re.compile(r"[ ().0-9-]++")
GROUP = re.compile(r"[0-9]++")
AUTHORITY = re.compile(r"[^\s/?#\"'<>\[\](){}|\\^`]++")
VEILED_DOMAIN = re.compile(r" ?([A-Za-z0-9-]++(?:(?: ?[\[({]dot[\])}] ?|\.)[A-Za-z0-9-]++)++)", re.IGNORECASE)
IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?: (?:number|no\.?|nr\.?))?[ :#=]{1,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z])", re.IGNORECASE)
NATIONAL = re.compile(r"[ :#=]{1,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    """Whether the last digit is right by the Luhn rule."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_checks(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def left_while(text: str, at: int, least: int, chars: frozenset[str]) -> int:
    """The start of the longest run of ``chars`` that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


class Finder:
    """The spans of one text; anchors come in order, and each base kind goes on where its last match ended."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.base: dict[str, list[Span]] = {k: [] for k in BASE}
        self.more: list[tuple[str, int, int]] = []
        self.done = dict.fromkeys(BASE, 0)

    def email(self, start: int, end: int) -> None:
        first = left_while(self.text, start, self.done["email"], LOCAL)
        if first < start and (m := DOMAIN.match(self.text, end)):
            self.base["email"].append((first, m.end()))
            self.done["email"] = m.end()

    def digit(self, start: int, end: int) -> None:
        if start >= self.done["ip"]:
            self.ip(start)
        if start >= self.done["card"]:
            self.card(start)

    def ip(self, start: int) -> None:
        """Every four parts of a dotted chain are a match, from the left."""
        whole = DOTTED.match(self.text, start)
        self.done["ip"] = whole.end()
        if self.text.find(".", start, whole.end()) < 0:
            return
        parts = [m.span() for m in GROUP.finditer(self.text, start, whole.end())]
        for k in range(0, len(parts) - 3, 4):
            if all(len(p := self.text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in parts[k : k + 4]):
                self.base["ip"].append((parts[k][0], parts[k + 3][1]))

    def card(self, start: int) -> None:
        end = SPACED.match(self.text, start).end()
        self.done["card"] = end
        if end - start < 16:
            return
        digits = "".join(GROUP.findall(self.text, start, end))
        if 16 <= len(digits) <= 19 and luhn(digits):
            self.base["card"].append((start, end))
        elif len(digits) > 19:
            self.cards_within(start, end)

    def cards_within(self, start: int, end: int) -> None:
        """Card numbers in a longer run: a group of 16 digits, or four of 4, that begin like a card's and pass the rule."""
        groups = [m.span() for m in GROUP.finditer(self.text, start, end)]
        k = 0
        while k < len(groups):
            for many, width in ((1, 16), (4, 4)):
                some = groups[k : k + many]
                if len(some) == many and all(b - a == width for a, b in some):
                    digits = "".join(self.text[a:b] for a, b in some)
                    if digits[0] in "23456" and luhn(digits):
                        self.more.append(("card", some[0][0], some[-1][1]))
                        k += many - 1
                        break
            k += 1

    def phone(self, start: int, end: int) -> None:
        """After the plus sign and a digit as many of a number's characters as there are, back to the last digit."""
        m = DIALLED.match(self.text, end)
        if m is None:
            return
        last = m.end()
        while last > m.start() and self.text[last - 1] not in DIGITS:
            last -= 1
        if last - m.start() < 2:
            return
        groups = [(end - 1, end), *(g.span() for g in GROUP.finditer(self.text, end, last))]
        count = sum(b - a for a, b in groups)
        if 8 <= count <= 15:
            self.base["phone"].append((start, last))
        elif count > 15:
            best, count = None, 0
            for a, b in groups:
                count += b - a
                if count > 15:
                    break
                if count >= 8 and not self.text[b : b + 1].isdigit():
                    best = b
            if best:
                self.more.append(("phone", start, best))

    def veiled(self, start: int, end: int) -> None:
        """An address whose at-sign is written out in brackets."""
        edge = start - (start > 0 and self.text[start - 1] == " ")
        first = left_while(self.text, edge, 0, LOCAL)
        if first < edge and (m := VEILED_DOMAIN.match(self.text, end)):
            self.more.append(("email", first, m.end(1)))

    def login(self, start: int, end: int) -> None:
        """A scheme and an authority that names a user: ``scheme://user:word@host``."""
        first = left_while(self.text, start, 0, LETTERS_DIGITS | frozenset("+.-"))
        if first < start and (m := AUTHORITY.match(self.text, end)) and (at := m[0].find("@")) > 0 and at < len(m[0]) - 1:
            self.more.append(("login", first, m.end()))

    def iban(self, start: int, end: int) -> None:
        if m := IBAN.match(self.text, end):
            first = m.start(1)
            for last in range(m.end(1), first + 14, -1):
                code = self.text[first:last].replace(" ", "")
                if self.text[last - 1] != " " and not self.text[last : last + 1].isalnum() and 15 <= len(code) and iban_checks(code):
                    self.more.append(("account", first, last))
                    return

    def account(self, start: int, end: int) -> None:
        if m := ACCOUNT.match(self.text, end):
            self.more.append(("account", *m.span(1)))

    def national(self, start: int, end: int) -> None:
        if m := NATIONAL.match(self.text, end):
            self.more.append(("national_id", *m.span(1)))

    def spans(self) -> list[tuple[str, int, int]]:
        """All spans, by kind and start; none that another of its kind covers was added."""
        base = {(k, *s) for k in BASE for s in self.base[k]}
        added = {m for m in self.more if not any(k == m[0] and a < m[2] and m[1] < b for k, a, b in base)} if self.more else set()
        return sorted(base | added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


#: Cues, and the parser that each calls. Words are found in these three ways of writing them.
CUES: dict[str, Callable[[Finder, int, int], None]] = {"@": Finder.email, "://": Finder.login}
CUES |= {f"+{d}": Finder.phone for d in DIGITS} | {d: Finder.digit for d in DIGITS}
for opening, closing in ("[]", "()", "{}"):
    CUES |= {f"{opening}{word}{closing}": Finder.veiled for word in ("at", "AT", "At")}
for cue, parser in (("iban", Finder.iban), ("account", Finder.account), ("acct", Finder.account), ("konto", Finder.account), ("ssn", Finder.national), ("social security number", Finder.national)):
    CUES |= {written_so: parser for written_so in (cue, cue.upper(), cue.capitalize())}


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for cue, parser in CUES.items():
        made.add_word(cue, (len(cue), parser))
    made.make_automaton()
    return made


def find(text: str, anchors: ahocorasick.Automaton) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """The base spans by kind, and all spans, of a whole text; places are code points, ends exclusive."""
    finder = Finder(text)
    for last, (size, parser) in anchors.iter(text):
        parser(finder, last + 1 - size, last + 1)
    return finder.base, finder.spans()


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    anchors = automaton()
    for batch in texts:
        out = []
        for text in batch:
            base, every = find(text or "", anchors)
            plain = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
            out.append((*(len(base[k]) for k in BASE), plain, ",".join(f"{k}:{a}:{b}" for k, a, b in every)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def personal_data(docs: DataFrame) -> DataFrame:
    """``(row, n_email, n_ip, n_card, n_phone, base, spans)`` for every row of ``docs (text, ...)``, which ``row`` holds whole.

    ``base`` and ``spans`` list ``kind:start:end``, comma-joined, by kind in the order of ``KINDS`` and then by start;
    the counts are those of ``base``. Null and empty texts hold nothing. Texts are read whole, however long. Repeated
    rows give the same row each. An empty table gives no rows.
    """
    seen = F.pandas_udf(found, COLUMNS)
    return docs.select(F.struct("*").alias("row"), F.col("text").alias("body")).select("row", seen("body").alias("x")).select("row", "x.*")


def digest(rows: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of what ``personal_data`` gives."""
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with ``<kind>`` in place of each listed span; of spans that overlap the one that starts first, and is longest, counts."""
    each = F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    each = F.array_sort(F.transform(each, lambda s: F.struct(s[1].cast("int").alias("start"), (-s[2].cast("int")).alias("minus_end"), s[0].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), (-s["minus_end"]).alias("at")),
    ).otherwise(a)
    return F.aggregate(each, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``<kind>`` in place of personal data in ``text``; a null text stays null. See ``personal_data``."""
    rows = personal_data(docs)
    text = F.when(F.col("row.text").isNotNull(), masked(F.col("row.text"), F.col("spans")))
    return rows.select(*((text if f.name == "text" else F.col("row").getField(f.name)).alias(f.name) for f in docs.schema))
