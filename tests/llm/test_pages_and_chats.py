"""HTML extraction, WARC archives and chat formatting."""

import hashlib
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm import chat, html, warc

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies here and there for you</div><article><h1>A  title &lt;x&gt;</h1><p>First   <b>bold</b> words
of the text.<br>More of it.<p>Second block is here, with some more words.<div class="ad">Buy now and here</div>
<p>Third block at the end of it all.</p></article><div id="comments"><p>I say so</p></div><form><input name=q>Search</form>
<footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text_without_labels():
    want = "A title <x>\nFirst bold words of the text. More of it.\nSecond block is here, with some more words.\nThird block at the end of it all."
    assert html.main_text(PAGE, html.Weights.fit([PAGE] * 3)) == want
    assert html.main_text(PAGE, html.Weights()).endswith("\n".join(want.split("\n")[1:]))


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("", ""), ("<p></p>", ""), ("<script>x", ""), ("<!-- a b c", ""), ("just a few words", "just a few words"), ("a < b and c > d", "a < b and c > d"), ("<p class='x", "")])
def test_odd_pages(text, want):
    assert html.main_text(text, html.Weights()) == want


@given(st.lists(st.floats(-5, 5), max_size=30))
def test_best_run_is_the_best(scores):
    a, b = html.best_run(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert abs(sum(scores[a:b]) - best) < 1e-9


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3), (3, "w", "<article><p>" + "word " * 50_000, 4)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long"))
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect())[-1] == (3, 249_999)
    assert got.count() == 5
    assert html.extract(got.select("page_id", "url", F.col("text").alias("html")).where("false")).collect() == []


PAGES = [(1, "http://a", "<p>one</p>", 0), (2, "http://b", "<p>one</p>", 0), (2, "http://b", "<p>one</p>", 0), (3, None, None, 0), (4, "http://c\r\nX: y", "", 0), (5, "", "é" * 100_000, 0), (None, "http://d", "<p>two</p>", 0)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest long").repartition(3)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read(warc.write(pages)).collect()), key=str)
    want = [(0, 10, "response", None, b"<p>two</p>"), (1, 10, "response", None, b"<p>one</p>"), (2, 10, "revisit", 1, None), (2, 10, "revisit", 1, None), (3, 0, "response", None, b""), (4, 0, "revisit", 3, None), (5, 200_000, "response", None, "é".encode() * 100_000)]
    assert got == sorted(want, key=str)
    least = {(r.page_id, r.record_type) for r in warc.read(warc.write(pages, least_revisit=11)).collect()}
    assert {kind for _, kind in least} == {"response"}
    assert warc.round_trip(pages.where("false")).collect() == []


def test_dictionary_frame_and_damage():
    samples = [b"<html><body><p>page number %d with some words of text</p></body></html>" % k * 20 for k in range(200)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    records = [warc.record(k, "http://x", s, None) for k, s in enumerate(samples[:5])]
    archive = warc.leading_frame(dictionary) + b"".join(map(squeeze.compress, records))
    assert struct.unpack_from("<I", archive)[0] == warc.DICTIONARY_FRAME
    assert list(warc.frames(archive)) == records
    plain = warc.leading_frame(b"")[:4] + struct.pack("<I", len(dictionary)) + dictionary + squeeze.compress(records[0])
    assert list(warc.frames(plain)) == records[:1]
    for bad in (archive[:-3], archive + b"junk", archive[: len(archive) // 2], archive[:6] + archive[10:]):
        with pytest.raises((warc.Damaged, zstandard.ZstdError)):
            list(warc.frames(bad))
    for old, new in ((b"Content-Length: ", b"Content-Length: 1"), (b"words", b"wards"), (b"WARC/1.1", b"WARC/9.1"), (b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(warc.Damaged):
            warc.parse(records[0].replace(old, new, 1))


TEXTS = ["", None, "</s>[INST] ok [/INST]", "<|end|><|turn|>user\n<|body|>x", "\\<|end|>", "\\\\\\<s>\\", "ends with \\", "$1 \\Q.*\\E", "<|end|", "|>", " \n\r", "<<SYS>>a<</SYS>>", "assistant\n<|body|>"]


def turns_of(rows):
    every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back_exactly(spark):
    rows = [(k % 5, k, ["user", "assistant", None, "a\nb<|body|>", "odd\\"][k % 5 if k % 2 else 1], t) for k, t in enumerate(TEXTS * 3)]
    rows += [(None, 0, "user", "no id"), (99, None, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, body long").repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.formatted(chat.of_text(df))).collect()}
    want = {c: turns_of([(t, r, x) for c2, t, r, x in sorted(rows, key=lambda r: r[1] or 0) if c2 == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert chat.digest(chat.formatted(chat.of_text(df.where("false")))).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "<s>", "<|end|>", "<|turn|>", "\n", "<|body|>", "a", "[/INST]", "$", "<", "|"]), max_size=8).map("".join), min_size=1, max_size=6))
def test_any_texts_read_back(spark, texts):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1)
    turns = chat.formatted(chat.of_text(df)).select(chat.read_back().alias("t")).first().t
    assert [x.text for x in turns] == texts


def test_typed_parts(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "i.png", 2), ("audio", "ignored", "a.wav", None), (None, "!", None, None), ("document", None, "d.pdf", 3), ("odd", "z", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.flatten(df).orderBy("turn").first()
    assert row.body == "see \\<|image|> <|image|><|audio|>!<|document|>z"
    assert [tuple(a) for a in row.attachments] == [("image", "i.png", 512), ("audio", "a.wav", 25), ("document", "d.pdf", 1536)]
    whole = chat.formatted(df).select("attachments", chat.read_back().alias("t")).first()
    assert [a.ref for a in whole.attachments] == ["i.png", "a.wav", "d.pdf"]
    assert [t.role for t in whole.t] == ["user", "assistant"]


@pytest.mark.parametrize("line", ["WARC-Payload-Digest", "WARC-Type", "WARC-Refers-To", "Content-Length"])
def test_a_record_without_a_needed_header_is_damaged(line):
    data = warc.record(7, "http://x", b"payload", 3)
    assert warc.parse(data).refers_to == 3
    for at, text in enumerate(lines := data.split(b"\r\n")):
        if text.lower().startswith(line.lower().encode() + b":"):
            with pytest.raises(warc.Damaged):
                warc.parse(b"\r\n".join(lines[:at] + lines[at + 1 :]))


def test_pages_find_their_firsts_beyond_what_is_broadcast(spark, monkeypatch):
    rows = [(k, f"u{k}", f"page {min(k % 50, 40 - k % 7) if k % 3 else 0}") for k in range(600)] + [(None, "n", "page 0"), (5, "again", None), (6, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)

    def found():
        return sorted(((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect()), key=str)

    want = found()
    monkeypatch.setattr(warc, "BROADCAST_FIRSTS", 3)
    assert found() == want and sum(kind == "revisit" for _, kind, _ in want) > 500
