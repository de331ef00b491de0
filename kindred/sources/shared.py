"""Tables for reuse in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, but only if all runs in one process.

    On a cluster a folder of the driver's own machine would be one folder on each executor, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master or 'the cluster'} share")
        folder = f"file://{tempfile.mkdtemp(prefix='kindred-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession) -> str:
    """The path of a folder for files of one's own in the shared folder, which is deleted when the application ends."""
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}"
    folder, store = opened(spark, path)
    store.deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that a lost executor costs no recomputation of what led to it.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder, store = opened(spark, path)
    store.deleteOnExit(folder)
    if OWNERS:
        TABLES.setdefault((spark.sparkContext.applicationId, OWNERS[-1]), set()).add(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the tables of ``written`` that ``df`` is read from; nothing that is still to be computed may read them."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith("kindred-"):
            folder, store = opened(df.sparkSession, path)
            store.delete(folder, True)


@contextmanager
def by_files(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, each file of a table that ``written`` made is a task of its own, and Python gets at most ``rows`` rows at a time.

    For rounds over a table whose rows are wide: they keep its number of tasks, and what a worker holds has a bound.
    """
    batch, opening = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.openCostInBytes"
    before = {c: spark.conf.get(c) for c in (batch, opening)}
    spark.conf.set(batch, str(max(1, min(rows, int(before[batch]) if int(before[batch]) > 0 else rows))))
    spark.conf.set(opening, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


#: Paths of the tables that were written for an application's owner, a run of stages, and not yet released.
TABLES: dict[tuple[str, str], set[str]] = {}
#: The owner of what is written now, last.
OWNERS: list[str] = []


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """What is written inside belongs to ``owner`` and goes when it releases it."""
    OWNERS.append(owner)
    try:
        yield
    finally:
        OWNERS.pop()


def opened(spark: SparkSession, path: str) -> tuple:
    """A path and its store, as Hadoop has them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: The key of a column's metadata under which a table says whose tables it was made from.
MADE_BY = "kindred.made_by"


def marked(df: DataFrame, owner: str) -> DataFrame:
    """``df``, saying that ``owner``'s tables led to it; so does every Parquet copy of it, and what reads that."""
    first = df.columns[0] if df.columns else None
    return df.withMetadata(first, df.schema[first].metadata | {MADE_BY: owner}) if first else df


def maker(df: DataFrame) -> str | None:
    """The owner that ``df`` was marked with."""
    return df.schema[0].metadata.get(MADE_BY) if df.columns else None


def release(docs: DataFrame, owner: str) -> None:
    """Deletes the tables written for ``owner``, but those that ``docs`` is read from, and lets Spark drop finished shuffles.

    For the beginning of a stage whose predecessors' results are written: nothing else of that owner that is still to be
    computed may read those tables.
    """
    spark = docs.sparkSession
    mine = TABLES.setdefault((spark.sparkContext.applicationId, owner), set())
    if not mine:
        return
    used = {part for f in docs.inputFiles() for part in f.split("/") if part.startswith("kindred-")}
    for path in sorted(p for p in mine if p.rsplit("/", 1)[1] not in used):
        folder, store = opened(spark, path)
        store.delete(folder, True)
        mine.discard(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver has forgotten their queries
