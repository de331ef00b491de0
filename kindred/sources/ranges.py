"""Lines of large text files by byte ranges, so that one file is read by many tasks and one bad file fails alone.

``LineRanges`` is a Python data source. It plans ranges over the files' bytes; a plain file is cut anywhere, a
block-gzipped one at the blocks that begin in a range, and a file in one gzip stream is left to its first range. A line
belongs to the range after whose first byte it begins, up to the range's end inclusive; so the reader of a later range
drops what comes before its first line break, and every reader goes on to the first line break after its end.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and that are read at once.
RANGE_BYTES, CHUNK = 32 << 20, 1 << 20
#: What opening a file counts for, in bytes, where small files share a task.
OPEN_BYTES = 4 << 10
#: Lines in a batch of rows, and their bytes at most, but for a line that is longer.
BATCH_LINES, BATCH_BYTES = 10_000, 4 << 20
#: Ranges whose line counts are broadcast at most.
MOST_RANGES = 1_000_000
#: The largest block of a block-gzipped file, and the bytes of a block's fixed header.
BLOCK_BYTES, HEADER_BYTES = 1 << 16, 12

LINES = "file string, range int, at int, line string, problem string"
COUNTS = "file string, range int, lines long, problem string"


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges of several small files that one task reads one after another."""

    parts: list[Range]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path)


def block_size(head: bytes) -> int | None:
    """The size of the block whose header ``head`` begins with; None if none does."""
    if len(head) < HEADER_BYTES or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = HEADER_BYTES, HEADER_BYTES + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def first_block(file: Any, start: int, size: int) -> int:
    """The first block that begins at ``start`` or after: a header with another, or the file's end, where it says it ends."""
    file.seek(start)
    window = file.read(3 * BLOCK_BYTES)
    at = window.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        length = block_size(window[at : at + 256])
        if length and (start + at + length == size or block_size(window[at + length : at + length + 256])):
            return start + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def plain_chunks(file: Any, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """A file's bytes from ``start`` on, and whether they come before ``end``."""
    file.seek(start)
    while start < end and (data := file.read(min(CHUNK, end - start))):
        start += len(data)
        yield data, True
    while data := file.read(CHUNK // 16):
        yield data, False


def block_chunks(file: Any, start: int, end: int, size: int) -> Iterator[tuple[bytes, bool]]:
    """The text of the blocks that begin from ``start`` on, and whether they begin before ``end``."""
    at = first_block(file, start, size) if start else 0
    while at < size:
        file.seek(at)
        head = file.read(BLOCK_BYTES)
        length = block_size(head)
        if length is None or at + length > size:
            raise EOFError(f"no whole block at byte {at}")
        yield zlib.decompress(head[:length], 31), at < end
        at += length


def stream_chunks(file: Any) -> Iterator[tuple[bytes, bool]]:
    """The text of all gzip members of a file."""
    file.seek(0)
    unzip, began = zlib.decompressobj(31), False
    while data := file.read(CHUNK):
        while data:
            began = True
            yield unzip.decompress(data), True
            data = unzip.unused_data
            if unzip.eof:
                unzip, began = zlib.decompressobj(31), False
    if began:
        raise EOFError("the file ended before the end of its gzip stream")


def chunks(part: Range) -> Iterator[tuple[bytes, bool]]:
    store, path = opened(part.path)
    with store.open_input_file(path) as file:
        size, head = file.size(), file.read(256)
        if head[:2] != b"\x1f\x8b":
            yield from plain_chunks(file, part.start, part.end)
        elif block_size(head):
            yield from block_chunks(file, part.start, part.end, size)
        elif part.start == 0:
            yield from stream_chunks(file)


def lines_of(part: Range) -> Iterator[list[bytes]]:
    """The lines of a range, without their line feeds, some at a time."""
    skip, rest = part.start > 0, []
    for data, inside in chunks(part):
        if inside:
            if skip:
                cut = data.find(b"\n")
                if cut < 0:
                    continue
                data, skip = data[cut + 1 :], False
            cut = data.rfind(b"\n")
            if cut < 0:
                rest.append(data)
                continue
            yield b"".join([*rest, data[:cut]]).split(b"\n")
            rest = [data[cut + 1 :]]
        elif skip:
            return  # the line that began before the range ends behind it
        else:
            cut = data.find(b"\n")
            rest.append(data if cut < 0 else data[:cut])
            if cut >= 0:
                yield [b"".join(rest)]
                return
    if not skip and (last := b"".join(rest)):
        yield [last]


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files: list[tuple[str, int]] = json.loads(options["files"])
        self.step = int(options.get("range_bytes", RANGE_BYTES))
        self.counting = options.get("counts") == "true"

    def partitions(self) -> list[Range | Ranges]:
        """The ranges, those of small files together up to the bytes of one range."""
        held: list[list[Range]] = []
        room = 0
        for path, size in self.files:
            for k, at in enumerate(range(0, max(size, 1), self.step)):
                end = min(at + self.step, size)
                cost = max(end - at, OPEN_BYTES)
                if cost > room:
                    held.append([])
                    room = self.step
                held[-1].append(Range(path, k, at, end))
                room -= cost
        return [parts[0] if len(parts) == 1 else Ranges(parts) for parts in held]

    def read(self, part: Range | Ranges | None) -> Iterator[pa.RecordBatch]:
        """Rows of the lines of a range or of several, or their number; without files Spark reads one partition that is None."""
        for one in [] if part is None else part.parts if isinstance(part, Ranges) else [part]:
            yield from self.read_range(one)

    def read_range(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Rows of the range's lines or their number; what goes wrong with its file is a row of its own, the last."""
        at, problem, held, size = 0, None, [], 0
        try:
            for some in lines_of(part):
                if self.counting:
                    at += len(some)
                    continue
                for line in some:
                    held.append(line)
                    size += len(line)
                    if len(held) == BATCH_LINES or size > BATCH_BYTES:
                        yield self.batch(part, at, held)
                        at, held, size = at + len(held), [], 0
        except Exception as e:  # noqa: BLE001  a file that can't be read is a result, not a failure of the job
            problem = f"{type(e).__name__}: {e}"
        if self.counting:
            yield pa.RecordBatch.from_pydict({"file": [part.path], "range": [part.number], "lines": [at], "problem": [problem]}, self.arrow(COUNTS))
        else:
            yield self.batch(part, at, held, problem)

    @staticmethod
    def arrow(schema: str) -> pa.Schema:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def batch(self, part: Range, at: int, lines: list[bytes], problem: str | None = None) -> pa.RecordBatch:
        text: list[str | None] = [x.decode("utf-8", "replace") for x in lines]
        n, more = len(text), [None] if problem else []
        return pa.RecordBatch.from_pydict(
            {"file": [part.path] * (n + len(more)), "range": [part.number] * (n + len(more)), "at": [*range(at + 1, at + n + 1), *more], "line": [*text, *more], "problem": [None] * n + [problem] * len(more)},
            self.arrow(LINES),
        )


class LineRanges(DataSource):
    """``(file, range, at, line, problem)``: ``at`` counts a range's lines from 1; or, with ``counts``, how many there are.

    Options: ``files`` (JSON list of path and bytes), ``range_bytes``, ``counts``.
    """

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return COUNTS if self.options.get("counts") == "true" else LINES

    def reader(self, schema: Any) -> RangeReader:
        return RangeReader(dict(self.options))


def listed(path: str, glob: str = "*") -> list[tuple[str, int]]:
    """Paths and sizes of the files at or under ``path`` whose names match, in order; hidden files are left out."""
    store, inner = opened(path)
    info = store.get_file_info(inner)
    found = store.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    good = (f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch(f.base_name, glob))
    return sorted((scheme + f.path, f.size) for f in good)


def line_ranges(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, counts: bool = False) -> DataFrame:
    """The rows of ``LineRanges`` for files and their sizes."""
    spark.dataSource.register(LineRanges)
    options = {"files": json.dumps(files), "range_bytes": str(range_bytes), "counts": str(counts).lower()}
    return spark.read.format("line_ranges").options(**options).load()


def numbered_lines(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, line_number, line, problem)``: lines numbered from 1 in their file, carriage returns at their ends dropped.

    Two passes: how many lines each range has, whose prefix sums by file are the numbers before it, then the lines. A
    file that can't be read to its end has its lines up to there, and one row with a ``problem`` and the line number 0
    for each range that failed. A file of no bytes has no rows.
    """
    n = sum(max(1, -(-size // range_bytes)) for _, size in files)
    counts = line_ranges(spark, files, range_bytes, counts=True)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("file", "range", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    lines = line_ranges(spark, files, range_bytes)
    rows = lines.join(F.broadcast(first) if n <= MOST_RANGES else first, ["file", "range"])
    number = F.when(F.col("problem").isNull(), F.col("before") + F.col("at")).otherwise(0)
    return rows.select("file", number.cast("int").alias("line_number"), F.regexp_replace("line", "\r$", "").alias("line"), "problem")


def pack_blocks(text: bytes, ended: bool = True) -> bytes:
    """``text`` as a block-gzipped file, or as the blocks of one that goes on."""
    out = []
    for at in range(0, len(text), BLOCK_BYTES - 256):
        raw = text[at : at + BLOCK_BYTES - 256]
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(raw) + squeeze.flush()
        out.append(block(body, raw))
    if ended:
        out.append(block(b"\x03\x00", b""))
    return b"".join(out)


def block(body: bytes, raw: bytes) -> bytes:
    size = HEADER_BYTES + 6 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + (size - 1).to_bytes(2, "little")
    return head + body + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")


def write_blocks(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``rows (part, line)``, sorted in each partition as they are to stand, as block-gzipped files ``<part>.gz``.

    Gives ``(file, bytes)``, written when it is computed; a partition has whole parts. A task that is run again writes its
    files again, the same way.
    """
    store, inner = opened(folder)
    store.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        held: list[bytes] = []
        name, out, sizes = None, None, {}
        for batch in batches:
            for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != name:
                    if out:
                        sizes[name] = finish(out, held)
                    name, held, out = part, [], where.open_output_stream(f"{base}/{part}.gz", compression=None)
                held.append(line.encode() + b"\n")
                if len(held) == 1000:
                    out.write(pack_blocks(b"".join(held), ended=False))
                    held = []
        if out:
            sizes[name] = finish(out, held)
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{k}.gz" for k in sizes], "bytes": list(sizes.values())}, pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    return rows.select(F.col("part").cast("string"), "line").mapInArrow(run, "file string, bytes long")


def finish(out: Any, held: list[bytes]) -> int:
    out.write(pack_blocks(b"".join(held)))
    size = out.tell()
    out.close()
    return size
