"""Exact numbers of any legal length: a sign and the digits before and after the point, as text.

A swap's amounts may have a hundred characters and exponents, far beyond what a decimal column holds. Here
nothing is rounded and nothing becomes null but text that is no number. Values can be compared (``wide_key`` sorts as the numbers do),
made absolute, written canonically and added up; sums go limb by limb through an ordinary aggregate. JVM expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.parsing import DECIMAL_TEXT

#: Characters a number may have.
MOST_CHARACTERS = 100
LIMB_DIGITS = 9
_BASE = 10**LIMB_DIGITS


def _once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of ``value``, which is computed once however often ``build`` names it. Written out, nested uses would multiply."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _stripped(whole: Column, part: Column, negative: Column) -> Column:
    """The canonical struct: no zeros in front or behind, no negative zero."""
    bare = F.struct(
        F.regexp_replace(whole, "^0+", "").alias("whole"), F.regexp_replace(part, "0+$", "").alias("part"), negative.alias("negative")
    )
    return _once(
        bare,
        lambda x: F.struct(
            (x["negative"] & ((x["whole"] != "") | (x["part"] != ""))).alias("negative"), x["whole"].alias("whole"), x["part"].alias("part")
        ),
    )


def _split(text: Column) -> Column:
    """struct of sign, all digits, and where the point stands in them."""
    first = F.regexp_extract(text, "^[+-]?([0-9]*)", 1)
    exponent = F.coalesce(F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.struct(
        text.startswith("-").alias("negative"),
        F.concat(first, F.regexp_extract(text, "[.]([0-9]*)", 1)).alias("digits"),
        (F.length(first) + exponent).alias("point"),
    )


def _placed(x: Column) -> Column:
    """Zeros where the point lies outside the digits, then the digits on either side of it."""
    before = F.repeat(F.lit("0"), F.greatest(-x["point"], F.lit(0)))
    behind = F.repeat(F.lit("0"), F.greatest(x["point"] - F.length(x["digits"]), F.lit(0)))
    all_digits = F.struct(F.concat(before, x["digits"], behind).alias("digits"), F.greatest(x["point"], F.lit(0)).alias("at"), x["negative"].alias("negative"))
    return _once(
        all_digits,
        lambda y: _stripped(F.substring(y["digits"], F.lit(1), y["at"]), F.substring(y["digits"], y["at"] + 1, F.length(y["digits"])), y["negative"]),
    )


def as_wide(text: Column) -> Column:
    """struct negative, whole, part; null for text that is no number or has more than ``MOST_CHARACTERS``."""

    def read(t: Column) -> Column:
        legal = F.length(t).between(1, MOST_CHARACTERS) & t.rlike(DECIMAL_TEXT)
        return F.when(legal, _once(_split(t), _placed))

    return _once(F.trim(text.cast("string")), read)


def wide_of(value: Decimal | int | str) -> Column:
    return as_wide(F.lit(str(value)))


def wide_text(wide: Column) -> Column:
    """Canonical text: no exponent, no sign but minus, no zeros that say nothing."""

    def write(w: Column) -> Column:
        whole = F.when(w["whole"] == "", F.lit("0")).otherwise(w["whole"])
        part = F.when(w["part"] == "", F.lit("")).otherwise(F.concat(F.lit("."), w["part"]))
        return F.concat(F.when(w["negative"], F.lit("-")).otherwise(F.lit("")), whole, part)

    return _once(wide, lambda w: F.when(w.isNotNull(), write(w)))


def wide_abs(wide: Column) -> Column:
    def positive(w: Column) -> Column:
        return F.when(w.isNotNull(), F.struct(F.lit(False).alias("negative"), w["whole"].alias("whole"), w["part"].alias("part")))

    return _once(wide, positive)


def wide_key(wide: Column) -> Column:
    """Text in the order of the numbers: length of the whole part, then digits; for negative numbers all of it reversed."""

    def key(w: Column) -> Column:
        size = F.concat(F.lpad(F.length(w["whole"]).cast("string"), 3, "0"), w["whole"], F.lit("."), w["part"])
        reversed_size = F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))
        return F.when(w["negative"], reversed_size).when(~w["negative"], F.concat(F.lit("1"), size))

    return _once(wide, key)


def _limbs(wide: Column) -> Column:
    """(place, value) of the limbs of ``LIMB_DIGITS`` digits that are not zero; place 0 ends at the point, -1 begins there."""
    sign = F.when(wide["negative"], F.lit(-1)).otherwise(F.lit(1))

    def cut(digits: Column, n: Column, start, place) -> Column:
        numbers = F.sequence(F.lit(0), n - 1)
        limb = F.transform(
            numbers,
            lambda i: F.struct(
                place(i).cast("int").alias("place"),
                (sign * F.substring(digits, start(i), F.lit(LIMB_DIGITS)).cast("long")).alias("value"),
            ),
        )
        return F.when(n > 0, limb).otherwise(F.array().cast("array<struct<place: int, value: bigint>>"))

    many = F.ceil(F.length(wide["whole"]) / LIMB_DIGITS).cast("int")
    whole = F.lpad(wide["whole"], many * LIMB_DIGITS, "0")
    more = F.ceil(F.length(wide["part"]) / LIMB_DIGITS).cast("int")
    part = F.rpad(wide["part"], more * LIMB_DIGITS, "0")
    high = cut(whole, many, lambda i: i * LIMB_DIGITS + 1, lambda i: many - 1 - i)
    low = cut(part, more, lambda i: i * LIMB_DIGITS + 1, lambda i: -1 - i)
    return F.concat(high, low)


def _carried(sums: Column, sign: int) -> Column:
    """struct carry, limbs (text, lowest first): ``sums`` of limbs from the lowest place on, times ``sign``, with carries."""
    start = F.struct(F.lit(0).cast("decimal(28,0)").alias("carry"), F.array().cast("array<string>").alias("limbs"))

    def step(state, value):
        total = (value * F.lit(sign) + state["carry"]).cast("decimal(28,0)")
        rest = total % F.lit(_BASE)
        rest = F.when(rest < 0, rest + _BASE).otherwise(rest).cast("decimal(28,0)")
        carry = ((total - rest) / F.lit(_BASE)).cast("decimal(28,0)")
        limb = F.lpad(rest.cast("bigint").cast("string"), LIMB_DIGITS, "0")
        return F.struct(carry.alias("carry"), F.array_append(state["limbs"], limb).alias("limbs"))

    return F.aggregate(sums, start, step)


def wide_sums(df: DataFrame, keys: list[str], text: str, name: str = "total") -> DataFrame:
    """Per key the exact sum of the numbers in column ``text``, as canonical text; what is no number is left out.

    Limbs are added by an aggregate with map-side combination: a key that holds a third of all rows sends
    one row per limb and task. A key without any number sums to 0.
    """
    limbs = df.select(*keys, F.explode_outer(_once(as_wide(F.col(text)), lambda w: F.when(w.isNotNull(), _limbs(w)))).alias("_limb"))
    value = F.col("_limb.value").cast("decimal(18,0)")
    sums = limbs.groupBy(*keys, F.col("_limb.place").alias("_place")).agg(F.sum(value).alias("_value"))
    entries = F.map_from_entries(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "_value"))))
    per_key = sums.groupBy(*keys).agg(entries.alias("_limbs"), F.min("_place").alias("_low"), F.max("_place").alias("_high"))
    # From the lowest place, at most the one after the point, to three above the highest: room for the carries of any number of rows.
    low = F.least(F.coalesce("_low", F.lit(0)), F.lit(0))
    high = F.greatest(F.coalesce("_high", F.lit(0)), F.lit(0)) + 3
    zero = F.lit(0).cast("decimal(28,0)")
    dense = F.transform(F.sequence(low, high), lambda p: F.coalesce(F.try_element_at("_limbs", p), zero))
    signed = _once(dense, lambda d: F.struct(_carried(d, 1).alias("up"), _carried(d, -1).alias("down")))

    def written(x: Column) -> Column:
        negative = x["sums"]["up"]["carry"] < 0
        found = F.when(negative, x["sums"]["down"]["limbs"]).otherwise(x["sums"]["up"]["limbs"])

        def joined(y: Column) -> Column:
            whole = F.array_join(F.reverse(F.slice(y["limbs"], 1 - y["low"], F.size(y["limbs"]))), "")
            part = F.when(y["low"] < 0, F.array_join(F.reverse(F.slice(y["limbs"], F.lit(1), -y["low"])), "")).otherwise(F.lit(""))
            return wide_text(_stripped(whole, part, y["negative"]))

        return _once(F.struct(found.alias("limbs"), x["low"].alias("low"), negative.alias("negative")), joined)

    return per_key.select(*keys, _once(F.struct(signed.alias("sums"), low.alias("low")), written).alias(name))
