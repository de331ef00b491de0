"""Personal data: base spans against the plain patterns, added spans, awkward tables."""

import hashlib
import random
import re

import pytest

from kindred.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and passes_luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(m.span())
    return out


PIECES = ["a", "b.c", "@", "@", "x@y.z", ".", "+", "-", " ", "1", "12", "255", "4111111111111111", "0", "(", "555", ") ", "+1 (231) 555-1234"]
PIECES += ["1.2.3.4", "é", "\n", "a@b@c.de", ".com", "%_", "999", "[at]", "://", "IBAN ", "account no. 12345678"]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_the_patterns(seed):
    rng, anchors = random.Random(seed), pii.automaton()
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        base, spans = pii.find(text, anchors)
        assert base == brute(text), text
        assert {(k, *s) for k, found in base.items() for s in found} <= set(spans)


def test_numbers_of_any_length():
    anchors = pii.automaton()
    zeros, nines = "0" * 5000, "9" * 5000
    assert pii.find(f"{zeros}1.2.3.4 {nines}.1.1.1", anchors)[0] == {"email": [], "ip": [(0, 5007)], "card": [], "phone": []}
    assert pii.find(f"+{nines} {zeros}", anchors)[1] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail joe [at] example [dot] com now", [("email", "joe [at] example [dot] com")]),
        ("to IBAN: GB82 WEST 1234 5698 7654 32 now", [("account", "GB82 WEST 1234 5698 7654 32")]),
        ("to IBAN: GB82 WEST 1234 5698 7654 33 now", []),
        ("see ftp://bob:word@host/x", [("login", "ftp://bob:word@host")]),
        ("see https://host.org/x", []),
        ("Account no. 1234-5678-90.", [("account", "1234-5678-90")]),
        ("on account of 12 men", []),
        ("SSN 123-45-6789", [("national_id", "123-45-6789")]),
        ("SSN 000-45-6789", []),
        ("call +1 (231) 555-1234 4465758382889437 now", [("card", "4465758382889437"), ("phone", "+1 (231) 555-1234")]),
        ("4465758382889437 4465758382889437", [("card", "4465758382889437")] * 2),
        ("pay 4111 1111 1111 1111 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")] * 2),
        ("pay 4111 1111 1111 1112 4111 1111 1111 1112", []),
    ],
)
def test_parsers_add_what_the_patterns_miss(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, pii.automaton())[1]] == want


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op11_pii(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        base, row = brute(r.text or ""), got[r.doc_id]
        plain = [f"{k}:{a}:{b}" for k, found in base.items() for a, b in found]
        assert [row[f"n_{k}"] for k in base] == [len(found) for found in base.values()]
        assert row.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert set(plain) <= set(filter(None, row.spans.split(",")))
    assert sum(r.n_email for r in got.values()) > 5 and sum(r.n_card for r in got.values()) > 5


def test_awkward_rows(spark):
    long = "word " * 200_000 + "é joe@example.com"
    rows = [(1, None, 5, "x"), (1, "", 5, "x"), (None, long, 5, "x"), (2, "1.2.3.4", 5, "x"), (2, "1.2.3.4", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int, base string")
    got = sorted(((r.row.doc_id or 0, r.spans, r.n_ip) for r in pii.personal_data(df).collect()), key=str)
    assert got == [(0, f"email:{len(long) - 15}:{len(long)}", 0), (1, "", 0), (1, "", 0), (2, "ip:0:7", 1), (2, "ip:0:7", 1)]
    assert pii.digest(pii.personal_data(df.limit(0))).count() == 0


def test_redaction_covers_each_span_once(spark):
    rows = [(1, "é me@x.org, 4111 1111 1111 1111 and https://bob:pw@host.org/x +1 (231) 555-1234.", 1), (2, None, 2), (3, "clean", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_card int")
    got = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert got == {1: "é <email>, <card> and <login>/x <phone>.", 2: None, 3: "clean"}
    assert pii.redacted(df).columns == df.columns
