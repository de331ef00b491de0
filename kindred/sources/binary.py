"""Array archives, ZIP members and SQLite maps: a file a row of Spark's binary source, opened in its task."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G

MISSING = 255
# Fixed names of the archives' arrays.
NEEDED = ("dosage", "samples", "chrom", "pos", "rsid", "ref", "alt")
LOADINGS = ("chrom", "pos", "ref", "alt", "loadings", "pca_af")


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def text_of(value: object) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, chrom, pos, rsid, ref, alt, dosage)`` of dosage archives; 255 and masked cells are null.

    An archive is one value, 2 GB at most; its shape has to fit its samples, variants and mask.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                arc = np.load(io.BytesIO(data), allow_pickle=False)
                if lacking := [k for k in NEEDED if k not in arc.files]:
                    raise ValueError(f"{name} lacks {lacking}")
                dosage = arc["dosage"].astype(np.int16)
                if dosage.shape != (len(arc["samples"]), len(arc["pos"])):
                    raise ValueError(f"{name}: dosages are {dosage.shape}")
                gone = dosage == MISSING
                if "missing_mask_packed" in arc.files:
                    if tuple(arc["missing_mask_shape"]) != dosage.shape:
                        raise ValueError(f"{name}: the mask is {tuple(arc['missing_mask_shape'])}")
                    gone |= np.unpackbits(arc["missing_mask_packed"], count=dosage.size).reshape(dosage.shape).astype(bool)
                variants = {k: [text_of(v) for v in arc[k]] for k in ("chrom", "rsid", "ref", "alt")} | {"pos": arc["pos"].astype(np.int64)}
                for s, row, lost in zip(map(text_of, arc["samples"]), dosage, gone, strict=True):
                    yield pd.DataFrame(variants | {"sample_id": [s] * len(row), "dosage": pd.array([None if gap else int(v) for v, gap in zip(row, lost, strict=True)], "Int32")})

    rows = contents(spark, path).mapInPandas(run, "chrom string, rsid string, ref string, alt string, pos long, sample_id string, dosage int")
    return rows.withColumn("chrom", G.panel_chrom(F.col("chrom")))


def read_npy(spark: SparkSession, path: str, samples: list[str], variants: list[str]) -> DataFrame:
    """``(sample_id, rsid, dosage)`` of a dosage array whose rows and columns are named beside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                dosage = np.load(io.BytesIO(data), allow_pickle=False)
                if dosage.dtype != np.uint8 or dosage.shape != (len(samples), len(variants)):
                    raise ValueError(f"{name}: {dosage.dtype} of shape {dosage.shape}")
                for s, row in zip(samples, dosage, strict=True):
                    yield pd.DataFrame({"sample_id": [s] * len(row), "rsid": variants, "dosage": pd.array([None if v == MISSING else int(v) for v in row], "Int32")})

    return contents(spark, path).mapInPandas(run, "sample_id string, rsid string, dosage int")


def write_npz(d: DataFrame, path: str, most: int = 20_000_000) -> None:
    """A small cohort's dosages as one archive, a file that the driver writes; over ``most`` cells is an error.

    Calls are put together by variant on Spark, and the driver takes a variant's bytes at a time.
    """
    samples = [r[0] for r in d.select("sample_id").distinct().orderBy("sample_id").limit(most + 1).collect()]
    m = d.select("chrom", "pos", "rsid").distinct().count()
    if len(samples) * m > most:
        raise ValueError(f"{len(samples)} samples by {m} variants; write Parquet instead")
    at = {s: k for k, s in enumerate(samples)}
    rows = d.groupBy("chrom", "pos", "rsid").agg(F.min("ref").alias("ref"), F.min("alt").alias("alt"), F.collect_list(F.when(F.col("dosage").isNotNull(), F.struct("sample_id", "dosage"))).alias("calls"))
    out, found = np.full((len(samples), m), MISSING, np.uint8), []
    for k, r in enumerate(rows.orderBy("chrom", "pos", "rsid").toLocalIterator()):
        found.append((r.chrom, r.pos, r.rsid, r.ref, r.alt))
        for s, v in r.calls:
            out[at[s], k] = int(v)
    variants = pd.DataFrame(found, columns=["chrom", "pos", "rsid", "ref", "alt"])
    mask = out == MISSING
    np.savez(path, dosage=out, samples=np.array(samples, str), pos=variants["pos"].to_numpy(), missing_mask_packed=np.packbits(mask), missing_mask_shape=np.array(mask.shape), **{k: variants[k].to_numpy(str) for k in ("chrom", "rsid", "ref", "alt")})


def loadings_npz(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom, pos, ref, alt, loadings, pca_af, nth)`` of a loadings archive; ``nth`` is the row's place in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                arc = np.load(io.BytesIO(data), allow_pickle=False)
                if lacking := [k for k in LOADINGS if k not in arc.files]:
                    raise ValueError(f"{name} lacks {lacking}")
                text = {k: [text_of(v) for v in arc[k]] for k in ("chrom", "ref", "alt")}
                yield pd.DataFrame(text | {"pos": arc["pos"].astype(np.int64), "loadings": list(arc["loadings"].astype(float)), "pca_af": arc["pca_af"].astype(float), "nth": np.arange(len(arc["pos"]))})

    rows = contents(spark, path).mapInPandas(run, "chrom string, ref string, alt string, pos long, loadings array<double>, pca_af double, nth long")
    return rows.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", "ref", "alt", "loadings", "pca_af", "nth")


def zip_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """``(file, line_number, line)`` of a text member, at any depth, of ZIP archives; those without it give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    found = [n for n in archive.namelist() if n == member or n.endswith(f"/{member}")]
                    lines = archive.read(found[0]).decode("utf-8", "replace").splitlines() if found else []
                if lines:
                    yield pd.DataFrame({"file": [name] * len(lines), "line_number": range(1, len(lines) + 1), "line": lines}).astype({"line_number": "int32"})

    return contents(spark, path).mapInPandas(run, "file string, line_number int, line string")


def sqlite_locus_map(spark: SparkSession, path: str) -> DataFrame:
    """``(chrom, pos, rsid)`` of a SQLite map, without loci that have several rsids."""
    from ..operators.popgen import unambiguous_map

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(data)
                tables = {t for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                table = "grch38_non_rsids" if "grch38_non_rsids" in tables else "rsid_reference"
                have = {r[1].lower(): r[1] for r in con.execute(f"PRAGMA table_info({table})")}
                names = [next((have[a] for a in aliases if a in have), None) for aliases in (("chromosome", "chrom", "chr"), ("position", "pos"), ("rsid", "id"))]
                if None in names:
                    raise ValueError(f"{name}: {table} has {sorted(have)}")
                yield pd.read_sql(f'SELECT CAST("{names[0]}" AS TEXT) AS chrom, CAST("{names[1]}" AS INTEGER) AS pos, CAST("{names[2]}" AS TEXT) AS rsid FROM {table}', con)

    return unambiguous_map(contents(spark, path).mapInPandas(run, "chrom string, pos long, rsid string"))
