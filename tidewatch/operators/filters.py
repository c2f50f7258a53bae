"""Row filters and derived columns of swap and candidate tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import utc_date
from tidewatch.functions.parsing import as_decimal, decimal_of, long_of, usd_of
from tidewatch.functions.wide import as_wide, wide_abs, wide_key, wide_of, wide_text
from tidewatch.schemas import USD


def pool_time_range(df: DataFrame, pool: str, start: int, end: int) -> DataFrame:
    """Swaps of one pool in ``start..end``, both ends included, in time order.

    Plain comparisons on stored columns: parquet skips row groups by them, and day folders where
    the table has them.
    """
    if start > end:
        raise ValueError("start must not be after end")
    chosen = (F.col("pool") == pool.lower()) & F.col("timestamp").between(start, end)
    if "day" in df.columns:
        chosen &= F.col("day").between(utc_date(F.lit(start)), utc_date(F.lit(end)))
    # Swaps of one second follow each other as in the detectors, as far as narrow columns tell.
    numbers = [long_of(df, name) for name in ("block_number", "log_index") if name in df.columns]
    rest = [name for name in ("tx_hash",) if name in df.columns]
    return df.where(chosen).orderBy("timestamp", *numbers, *rest)


def lookback_hours(df: DataFrame, pool: str, end: int, hours: int = 24) -> DataFrame:
    return pool_time_range(df, pool, end - hours * 3600, end)


def min_usd(df: DataFrame, minimum: float) -> DataFrame:
    """``amount_usd >= minimum``; nothing happens for 0 and below or without the column."""
    if minimum <= 0 or "amount_usd" not in df.columns:
        return df
    return df.where(usd_of(df) >= float(minimum))


def by_pool(df: DataFrame, pool: str) -> DataFrame:
    return df.where(F.col("pool") == pool.lower())


def by_sender(df: DataFrame, sender: str) -> DataFrame:
    return df.where(F.col("sender") == sender.lower())


def by_value_range(
    df: DataFrame, low: Decimal | None = None, high: Decimal | None = None
) -> DataFrame:
    """Exact decimal bounds, both included, each optional. Every digit of a text counts, also with an exponent and beyond 18 places."""
    if low is not None:
        df = df.where(_compared(df, "amount_usd", low) >= 0)
    if high is not None:
        df = df.where(_compared(df, "amount_usd", high) <= 0)
    return df


def _compared(df: DataFrame, name: str, bound: Decimal) -> Column:
    """-1, 0 or 1: how a column of numbers lies to a bound. Text that a decimal holds is compared as one, other text digit by digit."""
    value, limit = decimal_of(df, name), F.lit(str(bound)).try_cast(USD)
    short = F.when(value > limit, 1).when(value < limit, -1).when(value == limit, 0)
    if df.schema[name].dataType.typeName() != "string":
        return short
    both = F.struct(wide_key(as_wide(F.col(name))).alias("key"), wide_key(wide_of(bound)).alias("bound"))
    compared = F.transform(F.array(both), lambda x: F.when(x["key"] > x["bound"], 1).when(x["key"] < x["bound"], -1).when(x["key"] == x["bound"], 0))
    exact = F.get(compared, F.lit(0))
    fits = value.isNotNull() & limit.isNotNull() & ~F.col(name).rlike("[eE]|[.][0-9]{19}")
    if -bound.as_tuple().exponent > 18:
        return exact
    return F.when(fits, short).otherwise(exact)


def min_confidence(df: DataFrame, minimum: float) -> DataFrame:
    return df.where(F.col("confidence_score") >= minimum) if minimum > 0 else df


def high_confidence(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return df.where(F.col("confidence_score") >= threshold)


def with_swap_values(df: DataFrame) -> DataFrame:
    """Adds ``usd_value``, ``abs_amount0`` and ``abs_amount1`` as exact decimals; for 1e20 and above see ``with_exact_values``."""
    return df.withColumns(
        {
            "usd_value": decimal_of(df, "amount_usd"),
            "abs_amount0": F.abs(decimal_of(df, "amount0")),
            "abs_amount1": F.abs(decimal_of(df, "amount1")),
        }
    )


def with_exact_values(df: DataFrame) -> DataFrame:
    """Adds ``usd_exact``, ``abs_amount0_exact`` and ``abs_amount1_exact``: canonical text, whatever the number of digits."""
    return df.withColumns(
        {
            "usd_exact": wide_text(as_wide(F.col("amount_usd"))),
            "abs_amount0_exact": wide_text(wide_abs(as_wide(F.col("amount0")))),
            "abs_amount1_exact": wide_text(wide_abs(as_wide(F.col("amount1")))),
        }
    )


def time_span_seconds() -> Column:
    return F.col("last_timestamp") - F.col("first_timestamp")


def with_pattern_values(patterns: DataFrame) -> DataFrame:
    """Adds duration, mean trade size (0 where undefined) and the single-address flag."""
    trades = F.col("metrics.trade_count")
    volume = as_decimal(F.col("metrics.volume_usd_total"), USD)
    return patterns.withColumns(
        {
            "duration_seconds": F.col("end_timestamp") - F.col("start_timestamp"),
            "avg_trade_size_usd": F.coalesce(
                F.try_divide(volume, trades.cast("decimal(10,0)")).cast("double"), F.lit(0.0)
            ),
            "is_single_address": F.col("metrics.unique_addresses") == 1,
        }
    )
