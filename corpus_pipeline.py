"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

A stage's result says in a column's metadata which call made it, and a Parquet copy says so too. A stage begins by
deleting what the call that made its input wrote for itself, unless the input is still read from it; tables of other calls
stay. So a result that is handed on as a written copy is used up.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontam, quality, simhash, substring
from kindred.llm.common import table, written
from kindred.llm.packing import pack
from kindred.sources.shared import OWNERS, maker, marked, owned, release


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """``function`` after what its input's maker wrote for itself is deleted; what it writes is its own, in ``run`` the run's."""

    @functools.wraps(function)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        running = bool(OWNERS)
        if made_by := OWNERS[-1] if running else maker(docs):
            release(docs, made_by)
        owner = OWNERS[-1] if running else f"stage-{uuid.uuid4().hex}"
        with owned(owner):
            found = function(spark, docs, sf_dir)
        return found if running else marked(found, owner)

    return begun


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model keeps, with their columns.

    Null and blank texts, and texts that fail the base check, go. Texts are read whole. Repeated rows are judged alike,
    and all stay or go. An empty table gives no rows.
    """
    return quality.keep(docs)


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: texts of a five-word similarity of 0.8.

    Null and blank texts are a group. A null id gives way to any other; of rows equal in id and text one stays, and of
    rows with one id but other texts that of the least hash. Texts are compared whole. An empty table gives no rows.
    """
    return simhash.representatives(docs, least=simhash.SIMILARITY)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words or more that start earlier in the corpus.

    ``n_chars``, where there is such a column, becomes the length of what is left. Null, empty and short texts stay as
    they are; a text of which nothing is left is empty. Of rows with one id neither is earlier. An empty table gives no rows.
    """
    done = substring.without_repeats(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    cut = {"text": text, "n_chars": F.length(text)}
    return done.select(*((cut[f.name].cast(f.dataType) if f.name in cut else F.col("row").getField(f.name)).alias(f.name) for f in docs.schema))


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, with their columns and repeats.

    Null and empty texts hold none, and stay. Texts are searched whole. An empty benchmark leaves every row, an empty
    table none.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    A null or empty text is the end id alone; a text longer than a sequence is cut. Rows with one id are documents of
    their own. An empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("substring", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", into_sequences),
]

#: SQL can express neither the label model nor the fingerprints; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    with owned(f"run-{uuid.uuid4().hex}"):
        for k, (_, apply) in enumerate(STAGES):
            docs = apply(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = written(docs)
    return docs
