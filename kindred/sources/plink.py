"""PLINK filesets: two bits a call, a variant after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import listed, numbered_lines, opened

MAGIC = bytes([0x6C, 0x1B, 0x01])
#: Two-bit codes of 2, 1, 0 copies of the first allele, and of a missing call.
HOM1, MISSING, HET, HOM2 = 0b00, 0b01, 0b10, 0b11


def pack(dosage: np.ndarray) -> bytes:
    """A variant's calls (copies of the first allele, -1 for missing) as bytes, the last padded with zeros."""
    codes = np.select([dosage == 2, dosage == 1, dosage == 0], [HOM1, HET, HOM2], MISSING).astype(np.uint8)
    codes = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes, samples: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    codes = np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1)[:samples]
    return np.select([codes == HOM1, codes == HET, codes == HOM2], [2, 1, 0], -1).astype(np.int8)


def encoded(d: DataFrame, samples: list) -> DataFrame:
    """``(chrom, pos, rsid, a1, a2, bed)``: a row a variant, its calls packed in the order of ``samples``.

    ``d`` is ``(sample_id, chrom, pos, rsid, a1, a2, dosage)`` with copies of a1; a variant's calls meet in one row.
    """
    place = {s: k for k, s in enumerate(samples)}
    rows = d.groupBy("chrom", "pos", "rsid", "a1", "a2").agg(F.collect_list(F.struct("sample_id", F.coalesce("dosage", F.lit(-1)).cast("int").alias("v"))).alias("calls"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = []
            for calls in b["calls"]:
                x = np.full(len(samples), -1)
                for c in calls:
                    x[place[c["sample_id"]]] = c["v"]
                packed.append(pack(x))
            yield b.drop(columns="calls").assign(bed=packed)

    return rows.mapInPandas(run, "chrom string, pos long, rsid string, a1 string, a2 string, bed binary")


def decoded(variants: DataFrame, samples: list) -> DataFrame:
    """The inverse of ``encoded``: a row a sample and variant, missing calls null."""
    kind = "string" if samples and isinstance(samples[0], str) else "long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x = unpack(r.bed, len(samples))
                yield pd.DataFrame({"sample_id": samples, "chrom": r.chrom, "pos": r.pos, "rsid": r.rsid, "a1": r.a1, "a2": r.a2, "dosage": pd.array(np.where(x < 0, 0, x), "Int32").copy() if (x >= 0).all() else pd.array([None if v < 0 else int(v) for v in x], "Int32")})

    return variants.mapInPandas(run, f"sample_id {kind}, chrom string, pos long, rsid string, a1 string, a2 string, dosage int")


def subset(variants: DataFrame, kept: DataFrame) -> DataFrame:
    """Variants of ``encoded`` form that ``kept (rsid)`` names; their bytes stay as they are."""
    return variants.join(kept.select("rsid").distinct(), "rsid", "left_semi")


def file_fields(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, p)``: the line's number from 0 and its fields, of the lines that aren't blank."""
    rows = numbered_lines(spark, listed(path))
    line = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "file", "problem"))).otherwise(F.trim("line"))
    return rows.select((F.col("line_number") - 1).alias("ord"), line.alias("line")).where("line <> ''").select("ord", F.split("line", r"\s+").alias("p"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, chrom, rsid, pos, a1, a2)`` in file order; the file is read by ranges."""
    p = F.col("p")
    return file_fields(spark, path).select("ord", p[0].alias("chrom"), p[1].alias("rsid"), p[3].cast("long").alias("pos"), p[4].alias("a1"), p[5].alias("a2"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, family_id, sample_id, father_id, mother_id, sex)`` in file order."""
    p = F.col("p")
    return file_fields(spark, path).select("ord", p[0].alias("family_id"), p[1].alias("sample_id"), p[2].alias("father_id"), p[3].alias("mother_id"), p[4].alias("sex"))


#: Bytes of a .bed that a task reads.
RANGE_BYTES = 32 << 20


def read_bed(spark: SparkSession, prefix: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Long dosages of a fileset. Variant k is at byte 3 + k * width of the .bed, so tasks read ranges of whole variants.

    A file that isn't variant-major, or whose size isn't that of whole variants of the .fam's samples, is an error.
    """
    samples = [r.sample_id for r in read_fam(spark, f"{prefix}.fam").orderBy("ord").collect()]
    width = max(1, -(-len(samples) // 4))
    store, path = opened(f"{prefix}.bed")
    size = store.get_file_info(path).size or 0
    with store.open_input_file(path) as file:
        magic = file.read(len(MAGIC))
    if magic != MAGIC or (size - len(MAGIC)) % width:
        raise ValueError("not a variant-major .bed of these samples")
    n, step = (size - len(MAGIC)) // width, max(1, range_bytes // width)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, inner = opened(f"{prefix}.bed")
        for b in batches:
            with own.open_input_file(inner) as file:
                for first in b["id"].tolist():
                    file.seek(len(MAGIC) + first * width)
                    data = file.read((min(first + step, n) - first) * width)
                    for at in range(0, len(data) // width, 10_000):
                        ks = range(at, min(len(data) // width, at + 10_000))
                        yield pd.DataFrame({"ord": [first + k for k in ks], "bed": [data[k * width : (k + 1) * width] for k in ks]}).astype({"ord": "int32"})

    rows = spark.range(0, n, step, max(1, min(-(-n // step), 100_000))).mapInPandas(read, "ord int, bed binary")
    return decoded(rows.join(read_bim(spark, f"{prefix}.bim"), "ord").select("chrom", "pos", "rsid", "a1", "a2", "bed"), samples)


def write_bed(d: DataFrame, prefix: str) -> None:
    """A fileset in files that one writer closes: variants come to it in order, a batch of rows at a time.

    The format is one file with a fixed order, so its sink is sequential; everything before it is not. ``prefix`` is a
    path the driver can write to.
    """
    from ..functions import genotype as G

    samples = [r[0] for r in d.select("sample_id").distinct().orderBy("sample_id").collect()]
    rows = encoded(d, samples).withColumn("rank", G.chrom_rank(F.col("chrom"))).orderBy("rank", "pos", "rsid")
    with open(f"{prefix}.bed", "wb") as bed, open(f"{prefix}.bim", "w") as bim:
        bed.write(MAGIC)
        for r in rows.toLocalIterator(prefetchPartitions=True):
            bed.write(r.bed)
            bim.write(f"{r.chrom}\t{r.rsid}\t0\t{r.pos}\t{r.a1}\t{r.a2}\n")
    with open(f"{prefix}.fam", "w") as fam:
        fam.writelines(f"{s}\t{s}\t0\t0\t0\t-9\n" for s in samples)
