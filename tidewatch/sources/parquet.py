"""Parquet in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.labels import utc_date
from tidewatch.functions.parsing import double_of
from tidewatch.schemas import SWAP_SCHEMA, TYPED_USD


def read_swaps(spark: SparkSession, path: str, schema: T.StructType = SWAP_SCHEMA) -> DataFrame:
    """Swap table with a fixed schema: no inference pass; columns and filters reach the scan."""
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_swaps(df: DataFrame, path: str) -> None:
    """Replaces the swap table, one folder per UTC day, so that time filters skip whole days.

    The rebalance gathers a day in few files of the advisory size and splits a day that is larger;
    without it every task would write a file for every day. Files are sorted by pool and time: row
    groups of other pools are skipped as well. Senders lie scattered in that order, so row groups have a Bloom filter of them, as
    large as their number asks for. The USD amount is also stored as a number (``TYPED_USD``): a minimum reaches the scan.
    """
    if "amount_usd" in df.columns and TYPED_USD not in df.columns:
        df = df.withColumn(TYPED_USD, double_of(df, "amount_usd"))
    by_day = df.withColumn("day", utc_date(F.col("timestamp"))).hint("rebalance", F.col("day"))
    in_order = by_day.sortWithinPartitions("day", "pool", "timestamp")
    writer = in_order.write.mode("overwrite").partitionBy("day").option("parquet.bloom.filter.enabled#sender", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
