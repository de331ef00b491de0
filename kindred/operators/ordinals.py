"""Places in an order of all rows, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows that a range of the order is meant to hold.
RANGE_ROWS = 250_000


def numbered(df: DataFrame, order: list[Column | str], name: str = "ord", within: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place from 1 on in ``order``, or among the rows that agree in ``within``, by which ``order`` begins.

    Rows are cut into ranges of the order; the ranges' counts, added up, say how many rows come before each. Only those
    counts, a row a range, are ever in one task. Rows equal in the whole order are numbered in any order. Nulls come
    first in ascending order. An empty table gives no rows.
    """
    names = df.columns
    cells = [F.expr(c) if isinstance(c, str) else c for c in order]
    rows = written(df)
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = written(rows.repartitionByRange(parts, *cells).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    counts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*cells)) + F.col("_before")
    out = ranged.join(F.broadcast(counts), "_range").select(*names, place.alias(name))
    if not within:
        return out
    out = written(out)
    first = out.groupBy(*within).agg((F.min(name) - 1).alias("_first"))
    same = F.lit(True)
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    first = first.withColumnsRenamed({c: f"_of_{c}" for c in within})
    return out.join(first, same).select(*names, (F.col(name) - F.col("_first")).alias(name))
