"""Cleaning of raw swap tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.parsing import long_of
from tidewatch.schemas import (
    ADDRESS_COLUMNS,
    AMOUNT_COLUMNS,
    DEDUP_KEY,
    SWAP_COLUMNS,
    SWAP_SCHEMA,
    require_columns,
)


def coerce_timestamp(df: DataFrame) -> DataFrame:
    """Timestamps as whole seconds; rows whose timestamp cannot be read are dropped."""
    require_columns(df, ["timestamp"])
    return df.withColumn("timestamp", long_of(df, "timestamp")).where(
        F.col("timestamp").isNotNull()
    )


def backfill_columns(df: DataFrame) -> DataFrame:
    """Adds the address, amount and hash columns a source lacks, as nulls."""
    absent = [
        name
        for name in ADDRESS_COLUMNS + AMOUNT_COLUMNS + ["tx_hash"]
        if name not in df.columns
    ]
    return df.withColumns({name: F.lit(None).cast("string") for name in absent})


def lowercase_addresses(df: DataFrame) -> DataFrame:
    """Addresses in lower case and without blanks at their ends, which would make them other addresses to every join."""
    return df.withColumns(
        {name: F.lower(F.trim(F.col(name).cast("string"))) for name in ADDRESS_COLUMNS}
    )


def stringify_amounts(df: DataFrame) -> DataFrame:
    """Amounts and hash as text, digits untouched: ``1.0`` and ``1.00`` stay different."""
    return df.withColumns(
        {name: F.col(name).cast("string") for name in AMOUNT_COLUMNS + ["tx_hash"]}
    )


def dedup_swaps(df: DataFrame) -> DataFrame:
    """One row per key: the smallest by block number, pool and the other columns, nulls first.

    An aggregate instead of ``row_number``: copies collapse before the shuffle, so a key that
    holds a large part of the table still sends one row per task.
    """
    key = [name for name in DEDUP_KEY if name in df.columns]
    rest = [name for name in df.columns if name not in key]
    lead = [name for name in ["block_number", "pool", "amount_usd", "tick"] if name in rest]
    ordered = lead + [
        name
        for name in rest
        if name not in lead and not isinstance(df.schema[name].dataType, T.MapType)
    ]
    if not ordered:
        return df.dropDuplicates(key)
    # Blocks as text would put 10000000 before 9999999.
    block = [long_of(df, "block_number").alias("_block")] if "block_number" in ordered else []
    kept = df.groupBy(*key).agg(F.min(F.struct(*block, *ordered)).alias("kept"))
    return kept.select(
        *[F.col(name) if name in key else F.col(f"kept.{name}") for name in df.columns]
    )


def clean_swaps(df: DataFrame) -> DataFrame:
    """Table ready for the detectors; keeps null addresses and amounts."""
    return dedup_swaps(stringify_amounts(lowercase_addresses(backfill_columns(coerce_timestamp(df)))))


def project_canonical(df: DataFrame) -> DataFrame:
    """The canonical columns in order and typed; absent ones as nulls."""
    kinds = {field.name: field.dataType for field in SWAP_SCHEMA}
    return df.select(
        *[
            (F.col(name).try_cast(kinds[name]) if name in df.columns else F.lit(None).cast(kinds[name])).alias(name)
            for name in SWAP_COLUMNS
        ]
    )
