"""Text to number without errors: what cannot be read becomes null, never NaN or infinity.

The cast alone is not enough: it also takes ``1d``, ``NaN`` and ``inf``, and Spark orders NaN above
every number, so a stray NaN would pass each ``>=`` filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import AMOUNT, TYPED_USD

# Exponents end at 99, so no text of legal length can reach infinity.
_DECIMAL = "[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?0*[0-9]{1,2})?"
DECIMAL_TEXT = f"^{_DECIMAL}$"
WHOLE_NUMBER_TEXT = "^[+-]?[0-9]+([.]0*)?$"


def _matched(text: Column, pattern: str) -> Column:
    """The number inside optional spaces, or the empty text, which every ``try_cast`` nulls.

    The input appears once in the expression. With a ``when(rlike, cast)`` it would appear twice at
    each level, and nested parsers would be evaluated over and over for each row.
    """
    return F.regexp_extract(text.cast("string"), f"^ *({pattern}) *$", 1)


def as_double(text: Column) -> Column:
    return _matched(text, _DECIMAL).try_cast("double")


def as_decimal(text: Column, to: T.DecimalType = AMOUNT) -> Column:
    return _matched(text, _DECIMAL).try_cast(to)


def as_long(text: Column) -> Column:
    """Integer text only; ``12.5`` and the empty text give null."""
    return _matched(text, "[+-]?[0-9]+").try_cast("bigint")


def as_truncated_long(text: Column) -> Column:
    """Any number, cut towards zero. Integer text keeps all its digits."""
    return F.coalesce(as_long(text), as_double(text).try_cast("bigint"))


def double_of(df: DataFrame, name: str) -> Column:
    """Column as a finite double; columns that are numbers already skip the text round trip."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.col(name).cast("double")
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return as_double(F.col(name))


def usd_of(df: DataFrame) -> Column:
    """The USD amount as a double: from its typed column where the table has one, so that comparisons reach the scan."""
    if TYPED_USD in df.columns and isinstance(df.schema[TYPED_USD].dataType, T.DoubleType):
        return F.col(TYPED_USD)
    return double_of(df, "amount_usd")


def decimal_of(df: DataFrame, name: str, to: T.DecimalType = AMOUNT) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        return F.col(name).try_cast(to)
    return as_decimal(F.col(name), to)


def long_of(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).cast("bigint")
    return as_truncated_long(F.col(name))


def _tie(steps: Column) -> tuple[Column, Column]:
    """The odd number of half steps above ``steps`` and its value as a double."""
    odd = (steps * 2 + 1).cast("double")
    return odd, odd / F.lit(20000.0)


def _high(tie: Column) -> Column:
    return F.floor(tie * F.lit(2.0**30)).cast("double") / F.lit(2.0**30)


def _nearest(value: Column, steps: Column, odd: Column, tie: Column, high: Column) -> Column:
    # How far the double ``tie`` misses the true tie, without rounding: 30 high bits and the rest
    # of ``tie`` times 20000 each fit into a double.
    missing = (odd - high * F.lit(20000.0)) - (tie - high) * F.lit(20000.0)
    up = (value > tie) | ((value == tie) & ((missing < 0) | ((missing == 0) & (steps % 2 == 1))))
    return (steps + F.when(up, 1).otherwise(0)).cast("double") / F.lit(10000.0)


def score_round(value: Column) -> Column:
    """Nearest four-decimal number of a double in 0..1, judged by its exact binary value.

    Spark's ``round`` looks at the shortest decimal text instead, and ``floor(x * 10000 + 0.5)`` at a
    product that is itself rounded; both differ from the exact value next to a tie.
    """
    steps = F.floor(value * F.lit(10000.0))
    odd, tie = _tie(steps)
    return _nearest(value, steps, odd, tie, _high(tie))


def with_score_round(df: DataFrame, column: str, name: str) -> DataFrame:
    """``score_round`` of ``column`` in its place as ``name``, in steps that are each computed once per row."""
    df = df.withColumn("_steps", F.floor(F.col(column) * F.lit(10000.0)))
    odd, tie = _tie(F.col("_steps"))
    df = df.withColumns({"_odd": odd, "_tie": tie}).withColumn("_high", _high(F.col("_tie")))
    steps = ["_steps", "_odd", "_tie", "_high"]
    return df.withColumn(name, _nearest(F.col(column), *[F.col(step) for step in steps])).drop(column, *steps)


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
