"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame a record.

An archive is a row ``(archive, content)``, as the binary-file source gives them. Writing and reading are separate: the
reader trusts nothing but the bytes, and checks frames, header lines, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, values, written

#: The skippable frame that holds a dictionary, by the WARC-Zstandard convention.
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
#: Payloads with copies whose first ids are broadcast: a digest and an id each, 50 MB in all.
BROADCAST_FIRSTS = 500_000
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:x-page:{}>"


class Damaged(ValueError):
    """An archive that breaks the format."""


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit if ``refers_to`` is given; its block then ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "urn:x-none").split()),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    """What a record says, after the checks."""

    page_id: int | None
    type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None


def page_of(record_id: str) -> int | None:
    if not record_id.startswith("<urn:x-page:") or not record_id.endswith(">"):
        raise Damaged(f"record id {record_id!r}")
    return int(record_id[12:-1]) if record_id[12:-1] else None


def headers(data: bytes, first: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    if not lines[0].encode().startswith(first):
        raise Damaged(f"starts with {lines[0]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in out:
            raise Damaged(f"header line {line!r}")
        out[name.lower()] = value.strip()
    return out


def number(length: str) -> int:
    if not (length.isascii() and length.isdigit()):
        raise Damaged(f"{length!r} is no length")
    return int(length)


def parse(data: bytes) -> Record:
    """A record from its uncompressed bytes."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = headers(head, b"WARC/1.")
    needed = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"}
    if not gap or not needed <= set(fields) or (fields["warc-type"] == "revisit" and "warc-refers-to" not in fields):
        raise Damaged("a needed header is missing")
    length = number(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Damaged(f"Content-Length {length}, but {len(rest) - 4} bytes")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    size = number(headers(http, b"HTTP/1.").get("content-length", ""))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or sha1(payload) != digest:
            raise Damaged("payload doesn't fit its length or digest")
        return Record(page_of(fields["warc-record-id"]), kind, size, digest, None, payload)
    if kind != "revisit" or payload:
        raise Damaged(f"record of type {kind!r} with {len(payload)} bytes")
    return Record(page_of(fields["warc-record-id"]), kind, size, digest, page_of(fields["warc-refers-to"]), None)


def leading_frame(dictionary: bytes) -> bytes:
    squeezed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(squeezed)) + squeezed


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, uncompressed; one frame each."""
    at, dictionary, view = 0, None, memoryview(content)
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        inner = content[8 : 8 + size]
        if len(inner) != size:
            raise Damaged("the dictionary's frame is cut off")
        if inner[:4] == zstandard.FRAME_HEADER:
            inner = zstandard.ZstdDecompressor().decompress(inner)
        dictionary, at = zstandard.ZstdCompressionDict(inner), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        if bytes(view[at : at + 4]) != zstandard.FRAME_HEADER:
            raise Damaged(f"no frame at byte {at}")
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 16384]
            if not piece:
                raise Damaged("the last frame is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def train(pages: DataFrame, sample: int = 256, size: int = 64 << 10, each: int = 32 << 10) -> bytes:
    """A dictionary from the start of ``sample`` pages, first by hash; empty if there is too little to learn from."""
    texts = [t.encode("utf-8", "replace") for t in few(pages.where("length(html) > 0"), sample, each)]
    if len(texts) < 16 or sum(map(len, texts)) < 4 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # the samples are too alike or too few for the trainer
        return b""


def with_firsts(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """``keyed (page_id, url, payload, digest)`` with ``first`` from ``firsts (digest, first, n)``, null where there is none.

    With the ids of what repeats beside each task no payload is shuffled. Where they are too many, the most frequent go
    beside each task, and the other payloads, of which none is frequent any more, meet theirs by digest.
    """
    if firsts.count() <= BROADCAST_FIRSTS:
        return keyed.join(F.broadcast(firsts.drop("n")), "digest", "left")
    most = written(firsts.orderBy(F.desc("n"), "digest").limit(BROADCAST_FIRSTS))
    met = keyed.join(F.broadcast(most.select("digest", F.col("first").alias("near"))), "digest", "left")
    # Rows that have met theirs are spread by their ids under a key that is no digest.
    met = met.withColumn("key", F.when(F.col("near").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    rest = firsts.join(F.broadcast(most.select("digest")), "digest", "left_anti").select(F.col("digest").alias("key"), F.col("first").alias("far"))
    return met.join(rest, "key", "left").withColumn("first", F.coalesce("near", "far"))


def write(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Archives ``(archive, content)`` of about ``ARCHIVE_BYTES``, a record for every row of ``pages``.

    Of pages with equal payloads of at least ``least_revisit`` bytes, those with the smallest page_id are responses and
    all others revisit it; if that id is null for all, all are responses. A null html is an empty payload. Payloads
    are told apart by SHA-1. Very long ones are one record as others are, other columns of ``pages`` are left out, and
    an empty table gives no archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    dictionary = train(pages)
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Ids alone are grouped, and only groups of two or more come back; texts aren't.
    firsts = keyed.where(F.octet_length("payload") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = with_firsts(keyed, written(firsts)).select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=known) if known else zstandard.ZstdCompressor(level=3)
        lead, part = leading_frame(dictionary) if dictionary else b"", TaskContext.get().partitionId()
        parts, size, n = [lead], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

        for b in batches:
            for page_id, url, body, refers_to in zip(*(values(c, 200) for c in b.columns), strict=True):
                parts.append(squeeze.compress(record(page_id, url, body, refers_to)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, size, n = [lead], 0, n + 1
        if size:
            yield archive()

    return rows.mapInArrow(run, "archive string, content binary")


def read(archives: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)`` for each record of ``archives (content)``.

    An archive is one value in memory, its records one after another. Repeated records give repeated rows, a record
    without an id a null one, a revisit a null payload. A damaged archive is an error; an empty one, or none, no rows.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows = []
                for data in frames(content.as_py()):
                    r = parse(data)
                    rows.append((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to, r.payload))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("content").mapInArrow(run, schema)


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """``(path, bytes)`` of the files, one an archive, that tasks write to ``folder``, a URI that they all reach.

    A file's name ends with its task's attempt, and it gets that name when it is whole; only those of finished tasks are
    in the result, so what a lost executor leaves behind is never read (see ``read_files``). For other stores than those
    that Arrow's file systems open, keep archives as rows of a table: ``read`` takes both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            paths, sizes = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = f"{name.removesuffix('.warc.zst')}-{attempt}.warc.zst"
                with store.open_output_stream(f"{root}/_{path}", compression=None) as out:
                    out.write(content.as_buffer())
                store.move(f"{root}/_{path}", f"{root}/{path}")
                paths.append(path)
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return written(archives.select("archive", "content").mapInArrow(run, "path string, bytes long"))


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """The records (as ``read`` gives them) of the files in ``folder`` that ``files (path)`` lists."""
    found = files.sparkSession.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.warc.zst").withColumn("name", F.substring_index("path", "/", -1))
    return read(found.join(files.select(F.col("path").alias("name")).distinct(), "name", "left_semi"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back: every column of ``read`` but payload."""
    return read(written(write(pages))).drop("payload")
