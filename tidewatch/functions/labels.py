"""Directions, times and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trade_direction(amount0: Column, amount1: Column) -> Column:
    """``buy``/``sell`` when both amounts agree, null when they do not or are unreadable."""
    return F.when((amount0 < 0) & (amount1 > 0), F.lit("buy")).when(
        (amount0 > 0) & (amount1 < 0), F.lit("sell")
    )


def trade_side(amount0: Column, amount1: Column) -> Column:
    """The same as a number: -2 buy, 2 sell, anything else (or null) neither."""
    return (F.signum(amount0) - F.signum(amount1)).cast("int")


def wash_direction(amount0: Column) -> Column:
    """The wash detector's own rule: negative ``amount0`` is a buy, all else a sell."""
    return F.when(amount0 < 0, F.lit("buy")).otherwise(F.lit("sell"))


def epoch_to_timestamp(seconds: Column) -> Column:
    """UTC wall-clock time that does not move with the session's time zone."""
    return F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def hour_of_day(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def utc_date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def floor_hour(seconds: Column) -> Column:
    return epoch_to_timestamp(seconds - F.pmod(seconds, F.lit(3600)))


def short_label(address: Column, head: int = 10, tail: int = 8) -> Column:
    return F.concat(F.substring(address, 1, head), F.lit("..."), F.right(address, F.lit(tail)))
