"""SQL of operators 7 to 9, real archive files, typed parts through the digest, other tokenizers, exact cuts."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__
from kindred.llm import chat, packing, sharding, simhash, warc

TABLES = ("documents", "pages", "conversations", "benchmark")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op7_substring", "op8_warc", "op9_chat"])
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, f"/root/testdata/{sf}")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    order = sorted(d[0] for d in found.description)
    assert sorted(df.columns) == order
    names = [d[0] for d in found.description]
    want = collections.Counter(tuple(r[names.index(c)] for c in order) for r in found.fetchall())
    assert collections.Counter(tuple(r) for r in df.select(*order).collect()) == want


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_archive_files(spark, pages, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/archives"
    files = warc.write_files(warc.write(pages), folder)
    (tmp_path / "archives" / "part-000000-000000-left.warc.zst").write_bytes(b"left by a lost task")
    names = {r.path for r in files.collect()}
    assert names and all((tmp_path / "archives" / n).stat().st_size for n in names)
    got = warc.read_files(files, folder).select("page_id", F.sha1("payload").alias("sha")).collect()
    assert collections.Counter(r.page_id for r in got) == collections.Counter(r.page_id for r in pages.collect())
    whole = {r.page_id: hashlib.sha1((r.html or "").encode()).hexdigest() for r in pages.collect()}
    assert all(r.sha in (None, whole[r.page_id]) for r in got) and sum(r.sha is not None for r in got) > 200


def test_archives_of_odd_tables(spark, pages):
    odd = pages.limit(20).withColumns({n: F.lit("x") for n in ("digest", "payload", "first", "n", "refers_to", "archive", "content", "h")})
    assert warc.round_trip(odd).count() == 20


def test_typed_parts_through_the_digest(spark):
    parts = [("text", "see </s> ", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", 3)]
    answer = [("text", "a [INST] b", None, None), ("document", None, "d.pdf", None), ("text", "!", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts, "x"), (1, 1, "assistant", answer, "x"), (2, 0, "user", None, "x")], f"conv_id long, turn long, role string, parts array<{chat.PART}>, body string")
    rows = {r.conv_id: r for r in chat.digest(chat.formatted(df)).collect()}
    loss = "a [INST] b<|document|>!"
    every = f"user\nsee </s> <|image|><|audio|>\nassistant\n{loss}\n"
    assert (rows[1].n_attachments, rows[1].attachment_tokens) == (3, 2 * 256 + 3 * 25 + 512)
    assert (rows[1].n_turns, rows[1].loss_chars, rows[1].loss_sha256, rows[1].turns_sha256) == (2, len(loss), hashlib.sha256(loss.encode()).hexdigest(), hashlib.sha256(every.encode()).hexdigest())
    assert (rows[2].n_attachments, rows[2].attachment_tokens, rows[2].n_turns) == (0, 0, 1)


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    letters = {c: k for k, c in enumerate("ABCDabcd \n.,xyzXYZ0123456789")} | {"[U]": 99}
    cased = Tokenizer(models.WordLevel(letters, unk_token="[U]"))  # keeps case and counts white space
    cased.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    cased.save(str(tmp_path / "cased.json"))
    known, end = packing.WordIds(str(tmp_path / "cased.json")), np.array([2], "<u4").tobytes()
    assert not known.by_word
    for text in ("Ab  c\nD", "", "x y", "ABC abc"):
        assert known.of(text.encode(), end).tolist() == [*cased.encode(text, add_special_tokens=False).ids, 2]
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).direct


def test_one_huge_word_is_packed_whole(spark):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    text = "ab" * 60_000
    docs = spark.createDataFrame([(1, text, 3), (2, "x", 4)], "doc_id long, text string, length long")
    got = [r for r in packing.pack(docs, tokenizer).collect() if r.doc_id == 1]
    ids = [*Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids, 2]
    assert {(r.start, r.ids_crc32) for r in got} == {(s, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)}


@pytest.mark.parametrize("n", [3, 7, 40])
def test_cuts_are_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), "é" * int(rng.integers(0, 400)) if k % 9 else None, "x", 5) for k in rng.permutation(300)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, shard string, part int").repartition(5), n).collect()
    total, before, slots = sum(len((t or "").encode()) + 16 for _, t, _, _ in rows), 0, collections.Counter()
    want = {}
    for i, t, _, _ in sorted(rows):
        size = len((t or "").encode()) + 16
        shard = min(n - 1, (2 * before + size) * n // (2 * total))  # of the row's middle
        want[i] = (size, None if t is None else zlib.crc32(t.encode()), shard, slots[shard])
        slots[shard] += 1
        before += size
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in got} == want
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)


def test_long_texts_and_clashing_names_in_fingerprints(spark):
    text = "Long words " * 200_000
    docs = spark.createDataFrame([(1, text, 1, 2), (2, text.lower(), 1, 2), (3, "short", 1, 2)], "doc_id long, text string, fp int, tile int")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.representatives(docs, least=0.8).collect()) == [1, 3]
