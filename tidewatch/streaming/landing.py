"""The row-wise steps of the fetch job on a folder that keeps receiving payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.labels import utc_date
from tidewatch.operators.cleaning import project_canonical
from tidewatch.sources.raw_json import broken_lines, normalise_payloads, parse_payloads


def _landed(spark: SparkSession, landed: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landed)


def _appended(rows: DataFrame, path: str, checkpoint: str, *days: str) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*days).trigger(availableNow=True).start()


def start_landing(
    spark: SparkSession, landed: str, swaps: str, checkpoint: str, files_per_batch: int = 1000, by_day: bool = False
) -> StreamingQuery:
    """Appends each new payload file to the swap table exactly once and stops when it has caught up.

    ``checkpoint`` remembers which files are done: the next start goes on from there.
    ``by_day`` writes day folders, as the fetch job does; a table keeps the layout that it was started with.
    """
    payloads = parse_payloads(_landed(spark, landed, files_per_batch))
    rows = project_canonical(normalise_payloads(payloads))
    if not by_day:
        return _appended(rows, swaps, checkpoint)
    return _appended(rows.withColumn("day", utc_date(F.col("timestamp"))), swaps, checkpoint, "day")


def start_rejected(
    spark: SparkSession, landed: str, rejected: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Appends the lines that are no JSON object, which ``start_landing`` leaves out, to a table of their own."""
    return _appended(broken_lines(_landed(spark, landed, files_per_batch)), rejected, checkpoint)
