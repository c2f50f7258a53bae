"""Profiles of swap and candidate tables.

Functions that read their input more than once expect a table (a parquet path or ``session.cut``),
not the plan of a detector. Sums of money and means of scores add decimals, so they do not depend
on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.labels import (
    epoch_to_timestamp,
    floor_hour,
    hour_of_day,
    short_label,
    utc_date,
)
from tidewatch.functions.parsing import as_decimal, double_of
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.schemas import AMOUNT, USD

HISTOGRAM_BINS = 50


def exact_sum(amount: str) -> Column:
    """Decimal sum of a double column by its shortest text, 0 without rows."""
    return F.coalesce(
        F.sum(F.col(amount).cast("string").try_cast(USD)).cast(AMOUNT), F.lit("0").cast(AMOUNT)
    )


def mean_score(score: str = "confidence_score") -> Column:
    """Mean of four-decimal scores, exact up to the final division."""
    total = F.sum(F.col(score).cast("decimal(5,4)")).cast("double")
    return F.try_divide(total, F.count(score).cast("double"))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


# --- swaps -----------------------------------------------------------------------------------


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact number of distinct values of each column, nulls not counted.

    A distinct and a count per column instead of one aggregate of all, which would copy each row once per column: every
    branch reads one column and shuffles its distinct values.
    """
    parts = None
    for name in columns:
        values = df.select(F.col(name).alias("value")).where("value IS NOT NULL").distinct()
        part = values.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in columns])


def _with_distinct(df: DataFrame, plain: dict[str, Column], distinct: dict[str, str], order: list[str]) -> DataFrame:
    """One row of ordinary aggregates and of distinct counts by the names in ``distinct``."""
    totals = df.agg(*[value.alias(name) for name, value in plain.items()])
    counts = distinct_counts(df, list(distinct.values())).select(*[F.col(column).alias(name) for name, column in distinct.items()])
    # Two rows with a part of the columns each become one.
    both = totals.unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in order])


def run_counters(swaps: DataFrame) -> DataFrame:
    """Rows and distinct pools before any filter."""
    return _with_distinct(
        swaps, {"total_swaps_analyzed": F.count(F.lit(1))}, {"pools_analyzed": "pool"}, ["total_swaps_analyzed", "pools_analyzed"]
    )


def swap_set_stats(swaps: DataFrame) -> DataFrame:
    plain = {
        "total_count": F.count(F.lit(1)),
        "first_timestamp": F.min("timestamp"),
        "last_timestamp": F.max("timestamp"),
        "first_block": F.min("block_number"),
        "last_block": F.max("block_number"),
    }
    distinct = {"unique_pools": "pool", "unique_senders": "sender", "unique_recipients": "recipient"}
    order = ["total_count", *distinct, *list(plain)[1:]]
    return _with_distinct(swaps, plain, distinct, order)


def numeric_summary(df: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of each numeric column, one row per column, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    parts = [F.count(F.lit(1)).alias("total_rows")]
    for name in names:
        parts.append(
            F.struct(
                F.lit(name).alias("column"),
                F.min(name).cast("double").alias("min"),
                F.max(name).cast("double").alias("max"),
                F.avg(name).cast("double").alias("mean"),
            ).alias(f"summary_{name}")
        )
    wide = df.agg(*parts)
    rows = F.array(*[F.col(f"summary_{name}") for name in names])
    return wide.select(F.explode(rows).alias("s"), "total_rows").select("s.*", "total_rows")


# --- detection runs --------------------------------------------------------------------------


def sandwich_summary(
    candidates: DataFrame, swaps: DataFrame, window_seconds: int, min_usd: float
) -> DataFrame:
    """One row: counters of the run and, where nothing could be found, the reason."""
    run = (
        swaps.select("pool", (double_of(swaps, "amount_usd") >= float(min_usd)).alias("large"))
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("swaps"),
                F.count_distinct("pool").alias("pools"),
                F.count_if("large").alias("large"),
            )
        )
        .scalar()
    )
    found = candidates.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_distinct("attacker").alias("unique_attackers"),
        F.count_if(F.col("confidence_score") >= 0.8).alias("high_confidence_count"),
    ).withColumn("run", run)
    status = F.when(F.col("run.swaps") == 0, F.lit("Empty DataFrame provided")).when(
        F.col("run.large") == 0, F.lit("No transactions above minimum USD threshold")
    )
    return found.select(
        "total_candidates",
        F.col("run.swaps").alias("total_swaps_analyzed"),
        F.col("run.pools").alias("pools_analyzed"),
        F.lit(window_seconds).alias("time_window_seconds"),
        "unique_attackers",
        "high_confidence_count",
        status.alias("status"),
    )


def detection_metrics(candidates: DataFrame, swaps: DataFrame, threshold: float = 0.7) -> DataFrame:
    total_swaps = swaps.agg(F.count(F.lit(1))).scalar()
    found = candidates.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_distinct("attacker").alias("unique_attackers"),
        F.count_if(F.col("confidence_score") >= threshold).alias("high_confidence"),
        exact_sum("profit_estimate_usd").alias("total_profit_usd"),
    ).withColumn("total_swaps", total_swaps)
    return found.select(
        "total_swaps",
        "total_candidates",
        _percent(F.col("total_candidates"), F.col("total_swaps")).alias("detection_rate_percent"),
        "unique_attackers",
        "high_confidence",
        _percent(F.col("high_confidence"), F.col("total_candidates")).alias("high_confidence_percent"),
        "total_profit_usd",
    )


def sandwich_by_pool(candidates: DataFrame) -> DataFrame:
    return (
        candidates.groupBy("pool")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            mean_score().alias("avg_confidence"),
            exact_sum("profit_estimate_usd").alias("total_profit_usd"),
        )
        .orderBy(F.desc("candidates"), "pool")
    )


def attacker_profile(candidates: DataFrame) -> DataFrame:
    return (
        candidates.groupBy("attacker")
        .agg(
            F.count("victim_tx").alias("attack_count"),
            exact_sum("profit_estimate_usd").alias("total_profit_usd"),
            mean_score().alias("avg_confidence"),
        )
        .orderBy(F.desc("total_profit_usd"), "attacker")
    )


def wash_report_stats(candidates: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Counts, volume and means over the candidates that reach the score."""
    kept = F.col("confidence_score") >= min_confidence
    return candidates.where(kept).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.coalesce(F.sum(F.col("total_volume_usd").cast(USD)).cast(AMOUNT), F.lit("0").cast(AMOUNT)).alias(
            "total_volume_usd"
        ),
        mean_score().alias("avg_confidence"),
        F.avg("roundtrip_count").alias("avg_roundtrips"),
    )


def wash_pattern_rollup(patterns: DataFrame) -> DataFrame:
    """Counts over pattern records; volumes that cannot be read are left out of the sum."""
    kind = F.col("detection_type")
    volume = as_decimal(F.col("metrics.volume_usd_total"), USD)
    return patterns.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(F.col("confidence_score") >= 0.8).alias("high_confidence_count"),
        F.count_distinct("primary_address").alias("unique_addresses_involved"),
        F.count_distinct("pool").alias("pools_with_wash_trading"),
        F.coalesce(F.sum(volume).cast(AMOUNT), F.lit("0").cast(AMOUNT)).alias("total_volume_usd"),
        F.count_if(kind == "roundtrip").alias("roundtrip_count"),
        F.count_if(kind == "closed_loop").alias("closed_loop_count"),
    )


# --- time ------------------------------------------------------------------------------------


def _count_per(candidates: DataFrame, name: str, key: Column) -> DataFrame:
    return candidates.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("attacks"))


def hourly_timeline(candidates: DataFrame) -> DataFrame:
    return _count_per(candidates, "hour", floor_hour(F.col("victim_timestamp")))


def hour_of_day_counts(candidates: DataFrame) -> DataFrame:
    return _count_per(candidates, "hour_of_day", hour_of_day(F.col("victim_timestamp")))


def daily_counts(candidates: DataFrame) -> DataFrame:
    return _count_per(candidates, "day", utc_date(F.col("victim_timestamp")))


def peak_hour_day(candidates: DataFrame) -> DataFrame:
    """Busiest hour of the day and busiest day, the first one on ties."""

    def busiest(counts: DataFrame, key: str, order: Column) -> Column:
        best = F.struct(F.col("attacks"), -order)
        return counts.agg(F.struct(F.max_by(key, best).alias("key"), F.max("attacks").alias("n"))).scalar()

    hours, days = hour_of_day_counts(candidates), daily_counts(candidates)
    one = candidates.sparkSession.range(1)
    return one.select(
        busiest(hours, "hour_of_day", F.col("hour_of_day")).alias("h"),
        busiest(days, "day", F.unix_date("day")).alias("d"),
    ).select(
        F.col("h.key").alias("peak_hour"),
        F.col("h.n").alias("peak_hour_attacks"),
        F.col("d.key").alias("peak_day"),
        F.col("d.n").alias("peak_day_attacks"),
    )


# --- distributions ---------------------------------------------------------------------------


def profit_stats(candidates: DataFrame) -> DataFrame:
    (median,) = exact_percentiles(candidates, "profit_estimate_usd", [0.5])
    total = exact_sum("profit_estimate_usd")
    return candidates.agg(
        total.alias("total_profit_usd"),
        F.try_divide(total.cast("double"), F.count("profit_estimate_usd").cast("double")).alias("mean_profit"),
        F.lit(median).cast("double").alias("median_profit"),
        F.max("profit_estimate_usd").alias("max_profit"),
        F.min("profit_estimate_usd").alias("min_profit"),
    )


def profit_q99(candidates: DataFrame) -> float | None:
    return exact_percentiles(candidates, "profit_estimate_usd", [0.99])[0]


def cap_outliers(candidates: DataFrame) -> DataFrame:
    """Candidates up to the 99th percentile of profit."""
    return candidates.where(F.col("profit_estimate_usd") <= F.lit(profit_q99(candidates)))


def box_stats(candidates: DataFrame) -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 interquartile ranges."""
    q1, median, q3 = exact_percentiles(candidates, "profit_estimate_usd", [0.25, 0.5, 0.75])
    value = F.col("profit_estimate_usd")
    reach = 1.5 * (q3 - q1) if q1 is not None else None
    low, high = (q1 - reach, q3 + reach) if q1 is not None else (None, None)
    return candidates.agg(
        F.lit(q1).cast("double").alias("q1"),
        F.lit(median).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        F.min(F.when(value >= F.lit(low), value)).alias("whisker_low"),
        F.max(F.when(value <= F.lit(high), value)).alias("whisker_high"),
        F.count_if((value < F.lit(low)) | (value > F.lit(high))).alias("outliers"),
    )


def confidence_profit_corr(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.corr("confidence_score", "profit_estimate_usd").alias("correlation"))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum, all bins closed below, the last one
    on both sides; empty bins are listed. Two passes: the range, then partial counts per bin."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    step = F.lit((high - low) / bins)
    edge = lambda index: F.lit(low) + index.cast("double") * step
    value = F.col(column)
    guess = F.least(F.floor((value - low) / step), F.lit(bins - 1))
    # Division may land one bin off; the edges decide.
    index = (
        F.when(value < edge(guess), guess - 1)
        .when((value >= edge(guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counts = df.where(value.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every_bin = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every_bin.join(counts, "bin", "left").select(
        (F.col("bin") + 1).cast("int").alias("bin"),
        edge(F.col("bin")).alias("lower"),
        F.when(F.col("bin") == bins - 1, F.lit(high)).otherwise(edge(F.col("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def confidence_ecdf(candidates: DataFrame) -> DataFrame:
    """Share of candidates at or below each score. Scores have four decimals, so the table that
    the window orders has at most 10,001 rows, whatever the number of candidates."""
    counts = candidates.groupBy("confidence_score").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy("confidence_score"))
    everything = F.sum("n").over(Window.partitionBy())
    return counts.select(
        "confidence_score",
        "n",
        (so_far.cast("double") / everything.cast("double") * 100).alias("cumulative_percent"),
    )


# --- ranked reports --------------------------------------------------------------------------


def _ranked(best: DataFrame, *order) -> DataFrame:
    """Rank 1..n on a result that ``limit`` has already made small."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_sandwiches(candidates: DataFrame, n: int = 20) -> DataFrame:
    order = [
        F.desc("confidence_score"), "pool", "front_run_timestamp", "front_run_tx", "victim_tx", "back_run_tx",
    ]
    return _ranked(candidates.orderBy(*order).limit(n), *order).select(
        "rank",
        short_label(F.col("attacker")).alias("attacker"),
        short_label(F.col("pool")).alias("pool"),
        "confidence_score",
        "profit_estimate_usd",
        short_label(F.col("victim_tx")).alias("victim"),
        "front_run_tx",
        "victim_tx",
        "back_run_tx",
    )


def wash_sorted(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("confidence_score"), "pool", "trader")


def top_wash(candidates: DataFrame, n: int = 10, min_confidence: float = 0.0) -> DataFrame:
    order = [F.desc("confidence_score"), "pool", "trader"]
    kept = candidates.where(F.col("confidence_score") >= min_confidence)
    return _ranked(kept.orderBy(*order).limit(n), *order).select(
        "rank",
        short_label(F.col("trader"), 6, 4).alias("trader_label"),
        short_label(F.col("pool"), 6, 4).alias("pool_label"),
        "trader",
        "pool",
        "roundtrip_count",
        "total_volume_usd",
        "avg_roundtrip_time",
        "confidence_score",
    )


def top_attackers(candidates: DataFrame, n: int = 10) -> DataFrame:
    return attacker_profile(candidates).limit(n)


def top_cases(candidates: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The most profitable of the candidates with a high score."""
    order = [F.desc("profit_estimate_usd"), "front_run_tx", "victim_tx", "back_run_tx"]
    return (
        candidates.where(F.col("confidence_score") >= threshold)
        .orderBy(*order)
        .limit(n)
        .select(
            "attacker",
            "victim_tx",
            epoch_to_timestamp(F.col("victim_timestamp")).alias("victim_time"),
            "confidence_score",
            "profit_estimate_usd",
            "front_run_tx",
            "back_run_tx",
        )
    )
