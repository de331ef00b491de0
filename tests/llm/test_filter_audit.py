"""The audit of filter orders, against applying every order to every document, and against its SQL."""

import collections
import itertools

import duckdb
import pytest

import __spark_entry__
from kindred.llm import audit

WHITE = " \t\n\r\x0b\x0c"


def words(text):
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """Rows of the audit by (part, order, step), by applying the filters in each order, document by document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    cards = []
    for i, text, lang in docs:
        t = text or ""
        ws = words(t)
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > first[t],
        }
        mine = [(q, x) for k, q, x in labels if k == i and i is not None]
        cards.append((lang or "", {f for f, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out, total = {}, collections.Counter()
    for part in {c[0] for c in cards}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [c for c in cards if c[0] == part], []
            for step, f in enumerate(order, 1):
                hit = [c for c in left if f in c[1]]
                redundant = sum(f in c[1] for c in gone)
                left, gone = [c for c in left if f not in c[1]], gone + hit
                total[part, f] += len(hit)
                alone = sum(c[0] == part and c[1] == {f} for c in cards)
                out[part, "".join(order), step] = [len(left), len(hit), redundant, alone, sum(c[2] for c in hit), sum(c[3] for c in hit)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


ODD = [
    (1, "a b " * 150, "en"), (2, "a b " * 150, "en"), (2, "a b " * 150, "en"), (3, None, None), (4, "", "en"), (5, "THE #1 " + "w " * 300, ""),
    (None, "a b " * 150, "fr"), (6, " ".join(f"w{k}" for k in range(250)), "fr"), (7, " ".join(f"W{k}" for k in range(250)), "fr"), (8, "x" * 300_000, "de"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]


def test_audit_equals_every_order_by_hand(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, lang string, fails int, digest string")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    rows = audit.interactions(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows) == 4 * 120 * 5
    assert got == brute(ODD, LABELS)


def test_states_are_shared_between_orders(spark):
    rows = spark.createDataFrame([("x", 1, 0, 3), ("x", 0, 1, 4), ("y", 0, 0, 0)], "part string, good int, toxic int, fails int")
    trie = audit.Trie(rows, 3)
    trie.walk()
    assert sorted(trie.edges) == list(range(7))  # of the 16 nodes of the trie of orders that have edges out
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert audit.interactions(one, labels).count() == 600


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df = __spark_entry__.queries()["op12_filter_audit"](spark, f"/root/testdata/{sf}")
    found = con.execute(__spark_entry__.oracle_sql()["op12_filter_audit"])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(tuple(r) for r in df.select(*names).collect()) == collections.Counter(found.fetchall())
