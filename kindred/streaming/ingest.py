"""New participants' files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import qc
from ..sources import text


def watch(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Canonical rows and issues of each new file under ``path``, appended below ``out``; each file is taken once.

    Checks that compare lines stay within a file, so a batch of whole files is judged as it would be in a batch job.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("_metadata.file_path").alias("file"), "value")

    def take(batch: DataFrame, n: int) -> None:
        rows = batch.select("file", F.posexplode(F.split("value", "\n")).alias("k", "line"))
        lines = rows.select(F.regexp_extract("file", text.PARTICIPANT, 1).alias("participant_id"), "file", (F.col("k") + 1).alias("line_number"), F.regexp_replace("line", "\r$", "").alias("line"))
        text.ddna(lines).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        qc.ddna_issues(lines).write.mode("overwrite").parquet(f"{out}/issues/batch={n}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
