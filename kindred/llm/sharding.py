"""Contiguous shards of equal bytes.

Rows are put in order of ``doc_id`` over range partitions, each partition's bytes are summed, and the prefix sums of
those totals give every row its place in the whole corpus's bytes. Cutting that line at equal targets gives shards that
follow each other in order. Only totals (a row a partition, or a partition and shard) are ever summed in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows a range partition is meant to hold.
PARTITION_ROWS = 250_000


def shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``. A row belongs to the shard in whose span of the
    byte line its middle lies, so a shard misses its target by at most one row's size at either end. ``slot`` counts a
    shard's rows from 0 in order. The law is ``bytes``; ``grown_shard`` is null, as one more shard would move the cuts.
    Null ids come first; rows with equal ids are ordered by their text's checksum and size, and rows equal in all three
    are interchangeable. A null text has a null checksum. An empty table gives no rows.
    """
    order = ["doc_id", "text_crc32", "size"]
    sized = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    sized = written(sized)
    parts = max(1, -(-sized.count() // PARTITION_ROWS))
    # The checksum and the random column keep rows with one id from meeting in one partition.
    spread = sized.withColumn("any", F.xxhash64(F.monotonically_increasing_id()))
    ranged = written(spread.repartitionByRange(parts, *order, "any").withColumn("part", F.spark_partition_id()).drop("any"))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(totals, "part").withColumn("end", F.col("base") + F.sum("size").over(within))
    # Twice the middle of the row, so that the arithmetic stays in whole numbers.
    shard = F.least(F.lit(n_shards - 1), F.floor((2 * F.col("end") - F.col("size")).cast("decimal(38,0)") * n_shards / (2 * F.col("total"))))
    placed = written(placed.select("part", *order, shard.cast("int").alias("shard")))

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("rows"))
    counts = counts.select("part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)) - 1
    return placed.join(counts, ["part", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
