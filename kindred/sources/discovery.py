"""Inputs as a user names them, files, folders and samplesheets, and a scan of them in which a bad file fails alone."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import MOST_RANGES, RANGE_BYTES, line_ranges, listed, numbered_lines, opened
from .shared import written

MANIFEST = "participant_id string, file string, source string"


def stem(path: str) -> str:
    """A file's name without its last suffix."""
    return posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]


def inputs(spark: SparkSession, paths: list[str], sheet: DataFrame | None = None, glob: str = "*.txt") -> DataFrame:
    """``(participant_id, file, source)``: a row for each file that a path names, and for each row of a samplesheet.

    A folder gives its files at any depth: one straight in it is named by its own stem, one further down by its folder.
    A path that names nothing stays as a row, to be reported. ``sheet`` has the columns of ``text.samplesheet``.
    """
    rows = []
    for path in paths:
        store, inner = opened(path)
        if store.get_file_info(inner).type != pafs.FileType.Directory:
            rows.append((stem(path) or path, path, f"input:{path}"))
            continue
        for file, _ in listed(path, glob):
            folder = posixpath.dirname(file)
            rows.append((stem(file) if folder == path.rstrip("/") else posixpath.basename(folder), file, f"dir:{path}"))
    found = spark.createDataFrame(rows, MANIFEST)
    if sheet is not None:
        found = found.unionByName(sheet.select("participant_id", F.col("path").alias("file"), F.lit("samplesheet").alias("source")))
    return found


def looked_up(found: DataFrame) -> DataFrame:
    """``found`` with ``bytes`` and, for a path that is no file, ``code`` and ``message``; paths are looked up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, codes, messages = [], [], []
            for path in b.column(0).to_pylist():
                size, code, message = look_up(path)
                sizes.append(size)
                codes.append(code)
                messages.append(message)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(codes, pa.string()), pa.array(messages, pa.string())], ["file", "bytes", "code", "message"])

    known = found.select("file").distinct().mapInArrow(run, "file string, bytes long, code string, message string")
    return found.join(known, "file")


def look_up(path: str) -> tuple[int | None, str | None, str | None]:
    """A file's size, or the code and message of what is wrong with its path."""
    try:
        store, inner = opened(path)
        info = store.get_file_info(inner)
    except Exception as e:  # noqa: BLE001  of whatever kind a store raises
        return None, "FILE_NOT_FOUND", f"{type(e).__name__}: {e}"
    if info.type == pafs.FileType.NotFound:
        return None, "FILE_NOT_FOUND", "file does not exist"
    if info.type != pafs.FileType.File:
        return None, "NOT_A_FILE", "path is not a regular file"
    return info.size, None, None


def known_files(found: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``looked_up`` inputs, and the paths and sizes of the files among them, as Spark's own file index keeps them."""
    known = written(looked_up(found))
    return known, [(r["file"], r["bytes"]) for r in known.where("code is null").select("file", "bytes").distinct().orderBy("file").collect()]


def line_counts(spark: SparkSession, found: DataFrame, range_bytes: Callable[[int], int] | int = RANGE_BYTES) -> DataFrame:
    """``(participant_id, file, lines)`` of ``inputs``: how many lines ``scan`` gives for each, without a row a line.

    A file is counted once, by ranges, however many participants name it. One without a line has no row.
    """
    known, files = known_files(found)
    step = range_bytes(sum(size for _, size in files)) if callable(range_bytes) else range_bytes
    counts = line_ranges(spark, files, step, counts=True).groupBy("file").agg(F.sum("lines").alias("lines")).where("lines > 0")
    who = known.where("code is null").select("participant_id", "file").distinct()
    return who.join(F.broadcast(counts) if len(files) <= MOST_RANGES else counts, "file").select("participant_id", "file", "lines")


def scan(spark: SparkSession, found: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The numbered lines of ``inputs``, and the issues of files: ``(participant_id, file, line_number, line)`` and
    ``(participant_id, file, line_number, severity, code, message)``.

    Issues have the line number 0. A path without a file is FILE_NOT_FOUND or NOT_A_FILE; a file that can't be opened is
    FILE_NOT_READABLE where the store says so, and READ_EXCEPTION if it can't be read to its end, with its lines up to
    there; a file from which nothing was read and of which nothing else is known is FILE_EMPTY. No file fails the job. A
    file that several participants name is read once, and its lines are each one's. Empty inputs give two empty tables.
    """
    known, files = known_files(found)
    rows = numbered_lines(spark, files, range_bytes)
    who = known.where("code is null").select("participant_id", "file").distinct()
    who = F.broadcast(who) if len(files) <= MOST_RANGES else who
    lines = rows.where("problem is null").join(who, "file").select("participant_id", "file", "line_number", "line")

    state = written(rows.groupBy("file").agg(F.count("line").alias("lines"), F.min("problem").alias("problem")))
    issue = lambda df, code, message: df.select("participant_id", "file", F.lit(0).alias("line_number"), F.lit("ERROR").alias("severity"), code.alias("code"), message.alias("message"))
    refused = F.col("problem").startswith("PermissionError")
    failed = known.join(state.where("problem is not null"), "file")
    unread = known.where("code is null").join(state, "file", "left_anti")
    issues = issue(known.where("code is not null"), F.col("code"), F.col("message"))
    issues = issues.unionByName(issue(failed, F.when(refused, "FILE_NOT_READABLE").otherwise("READ_EXCEPTION"), F.col("problem")))
    return lines, issues.unionByName(issue(unread, F.lit("FILE_EMPTY"), F.lit("file is zero bytes"))).distinct()
