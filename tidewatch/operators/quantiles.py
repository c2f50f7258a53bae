"""Exact interpolated percentiles, of a column and per group, without gathering a column or a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

_BINS = 1000


def exact_percentiles(
    df: DataFrame, column: str, probabilities: list[float], values_per_task: int = 1_000_000
) -> list[float | None]:
    """Percentiles of a column of finite doubles, linear between neighbours.

    Equal values are counted first. All ranks are then looked for at once: a histogram of a fixed number of bins brackets
    every one of them, until the brackets hold few enough distinct values for one task, which reads them off.
    How many passes that takes does not depend on the number of ranks, and a result not on the size.
    """
    counted = written(
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("n")),
        "counted",
    )
    size = counted.agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not size["distinct"]:
        return [None for _ in probabilities]
    positions = [p * (size["total"] - 1) for p in probabilities]
    ranks = sorted({rank for x in positions for rank in (math.floor(x), math.ceil(x))})
    whole = _Bracket(size["low"], size["high"], 0, size["distinct"])
    found = _order_statistics(counted, dict.fromkeys(ranks, whole), values_per_task)
    result = []
    for position in positions:
        below, above = found[math.floor(position)], found[math.ceil(position)]
        result.append(below + (above - below) * (position - math.floor(position)))
    return result


class _Bracket:
    """Values from ``low`` to ``high``, ``distinct`` of them; ``skipped`` rows lie below."""

    def __init__(self, low: float, high: float, skipped: int, distinct: int):
        self.low, self.high, self.skipped, self.distinct = low, high, skipped, distinct


def _numbered(brackets: list[_Bracket]) -> Column:
    """Number of the bracket that a value lies in, null outside. Brackets are equal or apart."""
    number = F.lit(None).cast("int")
    for i, b in enumerate(brackets):
        number = F.when(F.col("v").between(b.low, b.high), F.lit(i)).otherwise(number)
    return number


def _order_statistics(counted: DataFrame, of_rank: dict[int, _Bracket], values_per_task: int) -> dict[int, float]:
    """Value at each 0-based rank. Only bin counts, at most ``_BINS`` per rank, and the values found reach the driver."""
    found: dict[int, float] = {}
    while True:
        for rank, b in list(of_rank.items()):
            if b.low == b.high:
                found[rank] = b.low
                del of_rank[rank]
        if not of_rank:
            return found
        brackets = list({(b.low, b.high): b for b in of_rank.values()}.values())
        inside = counted.withColumn("bracket", _numbered(brackets)).where("bracket IS NOT NULL")
        if sum(b.distinct for b in brackets) <= values_per_task:
            return found | _read_off(inside, brackets, of_rank)
        low, width = F.lit(0.0), F.lit(1.0)
        for i, b in enumerate(brackets):
            low = F.when(F.col("bracket") == i, F.lit(b.low)).otherwise(low)
            width = F.when(F.col("bracket") == i, F.lit(max((b.high - b.low) / _BINS, 5e-324))).otherwise(width)
        bin_of = F.floor(F.least((F.col("v") - low) / width, F.lit(_BINS - 1.0)))
        bins = inside.groupBy("bracket", bin_of.alias("bin")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        inner: list[list[_Bracket]] = [[] for _ in brackets]
        for row in sorted(bins.collect(), key=lambda r: (r["bracket"], r["bin"])):
            own = inner[row["bracket"]]
            skipped = own[-1].after if own else brackets[row["bracket"]].skipped
            own.append(_Bracket(row["low"], row["high"], skipped, row["distinct"]))
            own[-1].after = skipped + row["n"]
        place = {(b.low, b.high): i for i, b in enumerate(brackets)}
        for rank, b in of_rank.items():
            of_rank[rank] = next(x for x in inner[place[b.low, b.high]] if x.after > rank)


def _read_off(inside: DataFrame, brackets: list[_Bracket], of_rank: dict[int, _Bracket]) -> dict[int, float]:
    """The values of all ranks from brackets that fit into one task."""
    skipped = F.lit(0)
    for i, b in enumerate(brackets):
        skipped = F.when(F.col("bracket") == i, F.lit(b.skipped)).otherwise(skipped)
    so_far = skipped + F.sum("n").over(Window.partitionBy("bracket").orderBy("v"))
    running = inside.select("v", "bracket", so_far.alias("so_far"))
    place = {(b.low, b.high): i for i, b in enumerate(brackets)}
    ranks = list(of_rank)
    first = [
        F.min(F.when((F.col("bracket") == place[of_rank[rank].low, of_rank[rank].high]) & (F.col("so_far") > rank), F.col("v"))) for rank in ranks
    ]
    return dict(zip(ranks, running.agg(*first).first(), strict=True))


def group_medians(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys and the exact median of ``column`` in each group, as ``median``; nulls do not count.

    Equal values are counted map-side. The counts are range-partitioned by key and value, so a group that holds a third of all
    rows is split, and each part needs to know only how many rows the parts before it have.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "medians")
    parts = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    # One row per group and part: bounded by the number of partitions.
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
    )
    within = Window.partitionBy(*keys, "part").orderBy("v")
    same = F.col("d.part") == F.col("p.part")
    for key in keys:
        same &= F.col(f"d.{key}").eqNullSafe(F.col(f"p.{key}"))
    ranked = dealt.withColumn("so_far", F.sum("n").over(within)).alias("d").join(parts.alias("p"), same)
    ranked = ranked.select(*[F.col(f"d.{k}").alias(k) for k in keys], "v", (F.col("offset") + F.col("so_far")).alias("so_far"), "total")
    low = F.min(F.when(F.col("so_far") > F.floor((F.col("total") - 1) / 2), F.col("v")))
    high = F.min(F.when(F.col("so_far") > F.floor(F.col("total") / 2), F.col("v")))
    return ranked.groupBy(*keys).agg(low.alias("low"), high.alias("high")).select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("median"))


#: Fixed value: makes the median deviation of a normal distribution its standard deviation.
MAD_FACTOR = 0.6745


def robust_z(df: DataFrame, keys: list[str], column: str, name: str = "robust_z") -> DataFrame:
    """Adds how many median deviations a value lies from the median of its group.

    Null where the value is null or half the group is equal to the median. A null key is a group.
    """

    def beside(rows: DataFrame, values: DataFrame, other: str) -> DataFrame:
        renamed = values.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("median").alias(other))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])

    value = F.col(column).cast("double")
    centred = beside(df, group_medians(df, keys, column), "_median").withColumn("_deviation", value - F.col("_median"))
    spread = group_medians(centred.withColumn("_deviation", F.abs("_deviation")), keys, "_deviation")
    scored = beside(centred, spread, "_spread")
    z = F.when(F.col("_spread") > 0, F.col("_deviation") * F.lit(MAD_FACTOR) / F.col("_spread"))
    return scored.withColumn(name, z).drop("_median", "_deviation", "_spread")
