"""What the text operators share: words, tables written for reuse, and components."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written

__all__ = ["connected_components", "few", "forget", "release", "shared_folder", "table", "values", "written"]

#: A word is a longest run without ASCII white space; ``bytes.split()`` cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(pages: DataFrame, n: int, each: int | None = None) -> list[str]:
    """The html of ``n`` pages at most, first by a hash of id and URL, and of each the first ``each`` characters.

    The pages are chosen by their hashes alone, so only the chosen ones' html leaves its partition.
    """
    rows = pages.select(F.xxhash64("page_id", "url").alias("h"), "page_id", "html")
    chosen = F.broadcast(rows.select("h").orderBy("h").limit(n).distinct())
    html = F.col("html") if each is None else F.substring("html", 1, each)
    return [r["html"] for r in rows.join(chosen, "h", "left_semi").select("h", "page_id", html.alias("html")).orderBy("h", "page_id").limit(n).collect()]


def values(column: pa.Array, step: int = 1000) -> Iterator:
    """The values of an Arrow column as Python objects, so many at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def release() -> None:
    """Gives back to the system what a finished task no longer needs: Spark keeps its Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of queries that are done and no longer referred to.

    What the first collection frees refers to more, which the second frees.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges (src, dst)``; root is the component's smallest node.

    Alternating large-star and small-star steps: each is a minimum by key and a join, and the number of rounds
    grows with the logarithm of the longest path. Each round's edges are written to the shared folder. Self-loops
    and repeated edges do no harm; no edges give no rows.
    """
    links = written(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
