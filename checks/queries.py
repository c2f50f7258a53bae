"""Registered queries: every operator, run over the whole ``events`` table as a swap table.

Decimals leave as text, which compares exactly; doubles that depend on the order of summation are
rounded to six places.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import labels, scoring
from tidewatch.functions.parsing import as_double
from tidewatch.functions.wide import wide_sums
from tidewatch.operators import cleaning, collusion, filters, patterns, profiling, quality
from tidewatch.operators.quantiles import exact_percentiles, robust_z
from tidewatch.operators.sandwich import (
    SandwichSettings,
    attacks_by_attacker,
    order_columns,
    reversal_pairs,
    sandwich_attacks,
    sandwich_candidates,
)
from tidewatch.operators.wash import WashSettings, consecutive_pairs, roundtrips, wash_trades
from tidewatch.plans import jobs
from tidewatch.schemas import SANDWICH_INPUT, SWAP_COLUMNS, WASH_INPUT
from tidewatch.session import cut, shared_folder
from tidewatch.sources import events, parquet, raw_json

# The events are sparser in time than swaps of a busy chain; windows and bounds are scaled to them.
SANDWICH = SandwichSettings(window_seconds=21600, min_usd=1000.0, similarity=0.5)
WASH = WashSettings(window_seconds=64800, min_usd=Decimal("500"), min_roundtrips=3)

# Pool of the first user group's clicks, a sender of that group, and a stretch of January 2024.
RANGE_START, RANGE_END = 1704412800, 1705276800

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, folder: _comparable(build(spark, folder))
    return build


def _comparable(df: DataFrame) -> DataFrame:
    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return value.cast("string").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(value, "; ").alias(field.name)
        return value

    return df.select(*[column(field) for field in df.schema.fields])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _swaps(spark: SparkSession, folder: str, traders: str = "attackers") -> DataFrame:
    return events.events_as_swaps(events.read_events(spark, folder), traders)


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return events.plant_bad_rows(_swaps(spark, folder))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return sandwich_candidates(_swaps(spark, folder), SANDWICH)


def _wash(spark: SparkSession, folder: str) -> DataFrame:
    return wash_trades(_swaps(spark, folder, "washers"), WASH)


def _pool() -> str:
    # Upper-case digits: the filters lower their argument.
    return "0X" + hashlib.sha256(b"click-0").hexdigest()[:40].upper()


# --- sources, sinks ----------------------------------------------------------------------------


@query
def scan_swaps(spark, folder):
    return _swaps(spark, folder)


@query
def scan_pool_time_range(spark, folder):
    return filters.pool_time_range(_swaps(spark, folder), _pool(), RANGE_START, RANGE_END)


@query
def scan_lookback_hours(spark, folder):
    return filters.lookback_hours(_swaps(spark, folder), _pool(), RANGE_END, 240)


@query
def scan_lookback_default(spark, folder):
    """The last 24 hours, which is the default."""
    return filters.lookback_hours(_swaps(spark, folder), _pool(), RANGE_END)


@query
def normalise_raw_swaps(spark, folder):
    text = cleaning.stringify_amounts(_swaps(spark, folder))
    payloads = events.swaps_as_payloads(text.withColumn("amount_usd", F.col("amount_usd").cast("string")))
    return raw_json.normalise_payloads(raw_json.parse_payloads(payloads))


@query
def project_canonical(spark, folder):
    narrow = _swaps(spark, folder).drop("recipient", "tick").withColumn("note", F.lit("extra"))
    return cleaning.project_canonical(narrow)


@query
def write_parquet(spark, folder):
    path = f"{shared_folder(spark)}/swaps-{uuid.uuid4().hex}"
    text = cleaning.project_canonical(_swaps(spark, folder))
    parquet.write_swaps(text, path)
    return parquet.read_swaps(spark, path).drop("day")


@query
def typed_empty(spark, folder):
    return sandwich_candidates(
        _swaps(spark, folder), SandwichSettings(21600, min_usd=1e15, similarity=0.5)
    )


@query
def empty_input_status(spark, folder):
    settings = SandwichSettings(21600, min_usd=1e15)
    swaps = _swaps(spark, folder)
    found = sandwich_candidates(swaps, settings)
    return profiling.sandwich_summary(found, swaps, settings.window_seconds, settings.min_usd)


@query
def candidates_to_table(spark, folder):
    flat = patterns.flat_patterns(patterns.wash_patterns(_swaps(spark, folder, "washers"), WASH))
    return _rounded(flat, "amount_similarity_score", "avg_trade_interval_seconds")


# --- cleaning, filters, derived columns ---------------------------------------------------------


@query
def coerce_timestamp(spark, folder):
    half = F.when(
        F.col("tick").cast("int") % 2 == 0, F.concat("timestamp", F.lit(".9"))
    ).otherwise(F.col("timestamp"))
    raw = _raw(spark, folder).withColumn("timestamp", half)
    return cleaning.coerce_timestamp(raw).select("timestamp", "block_number", "tx_hash")


@query
def lowercase_addresses(spark, folder):
    nulled = F.when(F.col("pool") != "0xinvalid", F.col("pool"))
    raw = _raw(spark, folder).withColumn("pool", nulled)
    return cleaning.lowercase_addresses(raw).select("tx_hash", "block_number", "pool", "sender", "recipient")


@query
def backfill_columns(spark, folder):
    narrow = _raw(spark, folder).drop("recipient", "amount1")
    return cleaning.backfill_columns(narrow).select(*SWAP_COLUMNS)


@query
def stringify_amounts(spark, folder):
    typed = _swaps(spark, folder)
    return cleaning.stringify_amounts(typed).select("tx_hash", "amount0", "amount1")


@query
def dedup_swaps(spark, folder):
    return cleaning.dedup_swaps(_raw(spark, folder))


@query
def dedup_hot_copies(spark, folder):
    """A third of all rows are copies of one swap, with other block numbers."""
    raw = _swaps(spark, folder)
    copied = F.col("block_number") % 3 == 0
    same = {
        "tx_hash": F.lit("0x" + "7" * 64),
        "timestamp": F.lit(RANGE_START),
        "sender": F.lit("0x" + "7" * 40),
        "recipient": F.lit("0x" + "7" * 40),
        "amount0": F.lit("-1.00").cast("decimal(18,2)"),
        "amount1": F.lit("1.00000").cast("decimal(20,5)"),
    }
    hot = raw.withColumns({k: F.when(copied, v).otherwise(F.col(k)) for k, v in same.items()})
    return cleaning.dedup_swaps(hot)


@query
def clean_swaps(spark, folder):
    return cleaning.clean_swaps(_raw(spark, folder))


@query
def filter_min_usd_clean(spark, folder):
    return filters.min_usd(_raw(spark, folder), 12345.0).select("tx_hash", "block_number", "amount_usd")


@query
def filter_min_usd_detect(spark, folder):
    unread = F.when(F.col("tick") == "7", F.lit("NaN")).otherwise(F.col("amount_usd"))
    raw = _raw(spark, folder).withColumn("amount_usd", unread)
    return filters.min_usd(raw, 100.0).select("tx_hash", "block_number", "amount_usd")


@query
def filter_by_pool(spark, folder):
    return filters.by_pool(_swaps(spark, folder), _pool())


@query
def filter_by_sender(spark, folder):
    return filters.by_sender(_swaps(spark, folder), "0X" + "0" * 39 + "7")


@query
def filter_by_value_range(spark, folder):
    swaps = filters.by_value_range(_swaps(spark, folder), Decimal("1000"), Decimal("5000.00"))
    return swaps.select("tx_hash", "amount_usd")


@query
def trade_direction(spark, folder):
    raw = _raw(spark, folder)
    side = labels.trade_direction(as_double(F.col("amount0")), as_double(F.col("amount1")))
    return raw.select("tx_hash", "block_number", F.coalesce(side, F.lit("neither")).alias("direction"))


@query
def wash_direction(spark, folder):
    amount0 = F.col("amount0").cast("double")
    return _swaps(spark, folder).select("tx_hash", labels.wash_direction(amount0).alias("direction"))


@query
def swap_derived(spark, folder):
    values = ["usd_value", "abs_amount0", "abs_amount1"]
    return filters.with_swap_values(_swaps(spark, folder)).select("tx_hash", *values)


@query
def filter_min_confidence(spark, folder):
    return filters.min_confidence(_found(spark, folder), 0.6)


@query
def filter_sure(spark, folder):
    """A bound that keeps few rows."""
    return filters.min_confidence(_found(spark, folder), 0.8)


@query
def high_confidence(spark, folder):
    return filters.high_confidence(_found(spark, folder), 0.7)


@query
def cap_outliers_q99(spark, folder):
    return profiling.cap_outliers(cut(_found(spark, folder)))


@query
def epoch_to_timestamp(spark, folder):
    when = labels.epoch_to_timestamp(F.col("timestamp"))
    return _swaps(spark, folder).select("tx_hash", when.alias("ts_utc"))


@query
def short_address(spark, folder):
    return _swaps(spark, folder).select(
        "tx_hash",
        labels.short_label(F.col("tx_hash")).alias("tx_label"),
        labels.short_label(F.col("sender"), 6, 4).alias("sender_label"),
    )


@query
def wash_candidate_derived(spark, folder):
    records = patterns.wash_patterns(_swaps(spark, folder, "washers"), WASH)
    derived = filters.with_pattern_values(records).select(
        "pool", "primary_address", "duration_seconds", "avg_trade_size_usd", "is_single_address"
    )
    return _rounded(derived, "avg_trade_size_usd")


# --- data quality -------------------------------------------------------------------------------


@query
def validate_swaps(spark, folder):
    return quality.with_swap_errors(_raw(spark, folder)).select(
        "tx_hash", "block_number", quality.is_valid().alias("is_valid"), quality.ERRORS
    )


@query
def validation_errors(spark, folder):
    checked = quality.with_swap_errors(_raw(spark, folder))
    return quality.validation_errors(checked, ["tx_hash", "block_number"])


@query
def validation_summary(spark, folder):
    checked = quality.with_swap_errors(_raw(spark, folder))
    return _rounded(quality.validation_summary(checked), "success_rate")


@query
def duplicate_count(spark, folder):
    return quality.duplicate_count(_raw(spark, folder))


@query
def check_schema(spark, folder):
    renamed = _raw(spark, folder).drop("tick").withColumnRenamed("sqrtPriceX96", "sqrt_price")
    return quality.schema_findings(renamed)


@query
def amount_consistency(spark, folder):
    ok = quality.amounts_consistent(F.col("amount0"), F.col("amount1"))
    return _raw(spark, folder).select("tx_hash", "block_number", ok.alias("consistent"))


@query
def usd_value_valid(spark, folder):
    ok = quality.usd_value_valid(F.col("amount_usd"), Decimal("1000"))
    return _raw(spark, folder).select("tx_hash", "block_number", ok.alias("usd_valid"))


@query
def validate_sandwich_candidates(spark, folder):
    """Every third candidate damaged in one of three ways."""
    kind = F.col("front_run_timestamp") % 9
    damaged = _found(spark, folder).withColumns(
        {
            "attacker": F.when(kind == 0, F.lit("0xnobody")).otherwise(F.col("attacker")),
            "victim_tx": F.when(kind == 3, F.lit("0x12")).otherwise(F.col("victim_tx")),
            "confidence_score": F.when(kind == 6, F.lit(1.5)).otherwise(F.col("confidence_score")),
        }
    )
    return quality.with_sandwich_errors(damaged).select(
        "front_run_tx", "victim_tx", "back_run_tx", "front_run_timestamp", "victim_timestamp", quality.ERRORS
    )


@query
def validate_wash_candidates(spark, folder):
    kind = F.col("first_timestamp") % 9
    damaged = _wash(spark, folder).withColumns(
        {
            "trader": F.when(kind == 0, F.lit("0xnobody")).otherwise(F.col("trader")),
            "roundtrip_count": F.when(kind == 3, F.lit(2)).otherwise(F.col("roundtrip_count")),
            "avg_roundtrip_time": F.when(kind == 6, F.lit(-1.0)).otherwise(F.col("avg_roundtrip_time")),
        }
    )
    return quality.with_wash_errors(damaged).select("pool", "first_tx", "last_tx", quality.ERRORS)


@query
def validate_wash_patterns(spark, folder):
    kind = F.col("start_timestamp") % 9
    records = patterns.wash_patterns(_swaps(spark, folder, "washers"), WASH)
    damaged = records.withColumns(
        {
            "detection_type": F.when(kind == 0, F.lit("spoofing")).otherwise(F.col("detection_type")),
            "related_tx_hashes": F.when(kind == 3, F.slice("related_tx_hashes", 1, 1)).otherwise(
                F.col("related_tx_hashes")
            ),
            "end_timestamp": F.when(kind == 6, F.col("start_timestamp") - 1).otherwise(
                F.col("end_timestamp")
            ),
            "description": F.when(kind == 7, F.lit("short")).otherwise(F.col("description")),
        }
    )
    return quality.with_pattern_errors(damaged).select("pool", "primary_address", quality.ERRORS)


@query
def quarantine(spark, folder):
    valid, invalid = quality.quarantine(quality.with_swap_errors(_raw(spark, folder)))
    key = ["tx_hash", "block_number", "timestamp"]
    return valid.select(*key, F.lit("valid").alias("part")).unionByName(
        invalid.select(*key, F.lit("quarantined").alias("part"))
    )


# --- sandwich detection -------------------------------------------------------------------------


@query
def sandwich_candidates_all(spark, folder):
    return _found(spark, folder)


@query
def sandwich_candidates_split(spark, folder):
    """The same table with join keys cut into tiles from a few pairs on: the result must not change."""
    small = SandwichSettings(21600, 1000.0, 0.5, pairs_per_task=100)
    return sandwich_candidates(_swaps(spark, folder), small)


def _hot(spark: SparkSession, folder: str) -> DataFrame:
    """All swaps in one pool and a third of them by one sender."""
    swaps = _swaps(spark, folder)
    router = F.when(F.col("block_number") % 3 == 0, F.lit("0x" + "5" * 40)).otherwise(F.col("sender"))
    return swaps.withColumns({"pool": F.lit("0x" + "9" * 40), "sender": router})


HOT = SandwichSettings(7200, 5000.0, 0.5, pairs_per_task=10_000)


@query
def sandwich_hot_pool(spark, folder):
    return sandwich_candidates(_hot(spark, folder), HOT)


@query
def sandwich_attacks_all(spark, folder):
    return sandwich_attacks(_swaps(spark, folder), SANDWICH)


@query
def sandwich_attacks_hot_pool(spark, folder):
    """The router's pairs, its victims counted: a window of a day, so each pair has many."""
    return sandwich_attacks(_hot(spark, folder), SandwichSettings(86400, 10000.0, 0.5))


@query
def attacker_totals(spark, folder):
    return attacks_by_attacker(sandwich_attacks(_swaps(spark, folder), SANDWICH))


@query
def reversal_pairs_all(spark, folder):
    return reversal_pairs(_swaps(spark, folder), SANDWICH)


@query
def sandwich_equi_pairs(spark, folder):
    """Same sender, same pool, opposite directions: amounts of any similarity."""
    loose = SandwichSettings(21600, 1000.0, 0.0)
    pairs = reversal_pairs(_swaps(spark, folder), loose)
    return pairs.select("pool", "attacker", "front_run_tx", "back_run_tx")


@query
def sandwich_interval(spark, folder):
    """A narrow window: only the range condition gets stricter."""
    return sandwich_candidates(_swaps(spark, folder), SandwichSettings(3600, 1000.0, 0.5))


@query
def sandwich_confidence(spark, folder):
    """The score over a grid of spans, similarities and sizes made from the rows."""
    swaps = _swaps(spark, folder)
    span = F.col("block_number") % 120
    usd = F.col("amount_usd").cast("double")
    front = usd * ((F.col("tick") % 10) + 1).cast("double") / F.lit(10.0)
    similarity = ((F.col("block_number") % 101).cast("double")) / F.lit(100.0)
    return swaps.select(
        "tx_hash", scoring.sandwich_confidence(span, similarity, usd, front).alias("confidence_score")
    )


@query
def amount_similarity(spark, folder):
    one, other = F.col("amount_usd").cast("double"), F.lit(5000.0)
    return _swaps(spark, folder).select(
        "tx_hash", scoring.amount_similarity(one, other).alias("similarity")
    )


@query
def profit_estimate(spark, folder):
    usd = F.col("amount_usd").cast("double")
    profit = scoring.profit_estimate(F.lit(5000.0), usd)
    return _swaps(spark, folder).select("tx_hash", profit.alias("profit"))


# --- wash detection -----------------------------------------------------------------------------


@query
def pool_time_order(spark, folder):
    swaps = _swaps(spark, folder)
    return swaps.orderBy("pool", "timestamp", *order_columns(swaps)).select("pool", "timestamp", "tx_hash")


def _legs(pairs: DataFrame) -> DataFrame:
    # Prices and ratios are single divisions and products: no rounding needed.
    return pairs.drop("row")


@query
def consecutive_pairs_all(spark, folder):
    return _legs(consecutive_pairs(_swaps(spark, folder, "washers"), WASH))


@query
def roundtrips_all(spark, folder):
    return _legs(roundtrips(_swaps(spark, folder, "washers"), WASH))


@query
def roundtrips_many_chunks(spark, folder):
    """One window per chunk: runs cross chunk borders everywhere; the result must not change."""
    settings = WashSettings(64800, Decimal("500"), 3, windows_per_chunk=1)
    return _legs(roundtrips(_swaps(spark, folder, "washers"), settings))


@query
def roundtrips_one_trader(spark, folder):
    """All swaps by one sender in one pool: chunks keep the work spread."""
    hot = _swaps(spark, folder).withColumns(
        {"pool": F.lit("0x" + "9" * 40), "sender": F.lit("0x" + "5" * 40)}
    )
    return _legs(roundtrips(hot, WashSettings(3600, Decimal("500"), 3, rows_per_task=50)))


@query
def wash_trades_all(spark, folder):
    return _rounded(_wash(spark, folder), "price_variance", "avg_roundtrip_time")


@query
def wash_trades_no_price(spark, folder):
    """Without pool prices the amounts give the dispersion."""
    swaps = _swaps(spark, folder, "washers").drop("sqrtPriceX96")
    return _rounded(wash_trades(swaps, WASH), "price_variance", "avg_roundtrip_time")


@query
def wash_first_last(spark, folder):
    columns = ["pool", "trader", "first_tx", "last_tx", "first_timestamp", "last_timestamp"]
    return _wash(spark, folder).select(*columns)


@query
def wash_confidence(spark, folder):
    swaps = _swaps(spark, folder)
    count = F.col("block_number") % 15 + 1
    spread = F.when(F.col("tick") % 7 != 0, (F.col("tick") % 130).cast("double") / F.lit(1000.0))
    gap = (F.col("block_number") % 300).cast("double")
    return swaps.select(
        "tx_hash", scoring.wash_confidence(count, spread, gap, 300).alias("confidence_score")
    )


@query
def sqrt_price_to_price(spark, folder):
    price = scoring.sqrt_price_to_price(F.col("sqrtPriceX96"))
    return _swaps(spark, folder).select("tx_hash", price.alias("price"))


@query
def price_dispersion(spark, folder):
    swaps = _swaps(spark, folder)
    price = F.when(F.col("tick") % 2 == 0, scoring.sqrt_price_to_price(F.col("sqrtPriceX96")))
    ratio = F.abs(F.col("amount0").cast("double"))
    spread = scoring.price_dispersion(price, ratio)
    return _rounded(swaps.groupBy("pool", "sender").agg(spread.alias("dispersion")), "dispersion")


@query
def wash_total_volume(spark, folder):
    return _wash(spark, folder).select("pool", "trader", "total_volume_usd")


@query
def wash_avg_time(spark, folder):
    return _rounded(
        _wash(spark, folder).select("pool", "trader", "avg_roundtrip_time"), "avg_roundtrip_time"
    )


# --- profiles -----------------------------------------------------------------------------------


@query
def run_counters(spark, folder):
    nulled = F.when(F.col("tick") % 10 != 0, F.col("pool"))
    return profiling.run_counters(_swaps(spark, folder).withColumn("pool", nulled))


@query
def sandwich_summary(spark, folder):
    swaps = _swaps(spark, folder)
    found = sandwich_candidates(swaps, SANDWICH)
    return profiling.sandwich_summary(found, swaps, SANDWICH.window_seconds, SANDWICH.min_usd)


@query
def sandwich_by_pool(spark, folder):
    return _rounded(profiling.sandwich_by_pool(_found(spark, folder)), "avg_confidence")


@query
def wash_report_stats(spark, folder):
    stats = profiling.wash_report_stats(_wash(spark, folder), 0.6)
    return _rounded(stats, "avg_confidence", "avg_roundtrips")


@query
def attacker_profile(spark, folder):
    return _rounded(profiling.attacker_profile(_found(spark, folder)), "avg_confidence")


@query
def hourly_timeline(spark, folder):
    return profiling.hourly_timeline(_found(spark, folder))


@query
def hour_of_day(spark, folder):
    return profiling.hour_of_day_counts(_found(spark, folder))


@query
def daily_counts(spark, folder):
    return profiling.daily_counts(_found(spark, folder))


@query
def peak_hour_day(spark, folder):
    return profiling.peak_hour_day(cut(_found(spark, folder)))


@query
def profit_stats(spark, folder):
    stats = profiling.profit_stats(cut(_found(spark, folder)))
    return _rounded(stats, "mean_profit", "median_profit", "max_profit", "min_profit")


@query
def profit_q99(spark, folder):
    found = cut(_found(spark, folder))
    q99 = profiling.profit_q99(found)
    counted = found.agg(F.count(F.lit(1)).alias("candidates"))
    return _rounded(counted.withColumn("profit_q99", F.lit(q99).cast("double")), "profit_q99")


@query
def percentile_brackets(spark, folder):
    """Percentiles of all swap values when no task may hold more than 50 distinct ones."""
    usd = _swaps(spark, folder).select(F.col("amount_usd").cast("double").alias("usd"))
    p = exact_percentiles(usd, "usd", [0.25, 0.5, 0.99], values_per_task=50)
    named = usd.agg(F.count("usd").alias("n")).withColumns(
        {name: F.lit(v).cast("double") for name, v in zip(["q25", "q50", "q99"], p, strict=True)}
    )
    return _rounded(named, "q25", "q50", "q99")


@query
def confidence_profit_corr(spark, folder):
    return _rounded(profiling.confidence_profit_corr(_found(spark, folder)), "correlation")


@query
def histogram_50(spark, folder):
    bins = profiling.histogram(cut(_found(spark, folder)), "confidence_score")
    return _rounded(bins, "lower", "upper")


@query
def histogram_50_profit(spark, folder):
    capped = profiling.cap_outliers(cut(_found(spark, folder)))
    return _rounded(profiling.histogram(capped, "profit_estimate_usd"), "lower", "upper")


@query
def confidence_ecdf(spark, folder):
    return _rounded(profiling.confidence_ecdf(_found(spark, folder)), "cumulative_percent")


@query
def box_stats(spark, folder):
    stats = profiling.box_stats(cut(_found(spark, folder)))
    return _rounded(stats, "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def detection_metrics(spark, folder):
    stats = profiling.detection_metrics(_found(spark, folder), _swaps(spark, folder))
    return _rounded(stats, "detection_rate_percent", "high_confidence_percent")


@query
def numeric_summary(spark, folder):
    text = cleaning.stringify_amounts(_swaps(spark, folder))
    return _rounded(profiling.numeric_summary(text.drop("amount_usd")), "mean")


@query
def swap_set_stats(spark, folder):
    return profiling.swap_set_stats(_swaps(spark, folder))


@query
def wash_pattern_rollup(spark, folder):
    records = patterns.wash_patterns(_swaps(spark, folder, "washers"), WASH)
    kind = F.when(F.col("start_timestamp") % 3 == 0, F.lit("closed_loop")).otherwise(
        F.col("detection_type")
    )
    return profiling.wash_pattern_rollup(records.withColumn("detection_type", kind))


# --- ranked reports -----------------------------------------------------------------------------


@query
def wash_sorted(spark, folder):
    return profiling.wash_sorted(_wash(spark, folder)).select("trader", "pool", "confidence_score")


@query
def top20_sandwiches(spark, folder):
    return profiling.top_sandwiches(_found(spark, folder), 20)


@query
def top10_wash(spark, folder):
    top = profiling.top_wash(_wash(spark, folder), 10, 0.5)
    return _rounded(top, "avg_roundtrip_time")


@query
def top10_attackers(spark, folder):
    return _rounded(profiling.top_attackers(_found(spark, folder), 10), "avg_confidence")


@query
def top5_cases(spark, folder):
    return profiling.top_cases(_found(spark, folder), 5, 0.6)


@query
def top5_sure_cases(spark, folder):
    """With the bound of the feature."""
    return profiling.top_cases(_found(spark, folder))


@query
def pools_by_count(spark, folder):
    return profiling.sandwich_by_pool(_found(spark, folder)).select("pool", "candidates")


@query
def error_sample(spark, folder):
    key = ["tx_hash", "block_number"]
    checked = quality.with_swap_errors(_raw(spark, folder))
    return quality.error_sample(quality.validation_errors(checked, key), key, 10)


# --- set operations -----------------------------------------------------------------------------


@query
def concat_pools(spark, folder):
    """Findings of runs over the two halves of the pools are those of one run."""
    swaps = _swaps(spark, folder)
    even = F.conv(F.substring("pool", -1, 1), 16, 10).cast("int") % 2 == 0
    one = sandwich_candidates(swaps.where(even), SANDWICH)
    return one.unionByName(sandwich_candidates(swaps.where(~even), SANDWICH))


@query
def distinct_attackers(spark, folder):
    return _found(spark, folder).select("attacker", "pool").distinct()


# --- exact numbers of any length ----------------------------------------------------------------


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of four shapes, by ``block_number % 4``: 35 zeros and 30 places, plain, and exponents of 40 and -30."""
    b = F.col("block_number").cast("string")
    shape = F.col("block_number") % 4
    text = (
        F.when(shape == 0, F.concat(F.lit("-"), b, F.lit("0" * 35 + "."), F.lpad(b, 30, "0")))
        .when(shape == 1, F.concat(F.lit("+000"), b, F.lit(".500")))
        .when(shape == 2, F.concat(b, F.lit("e40")))
        .otherwise(F.concat(b, F.lit("E-30")))
    )
    swaps = _swaps(spark, folder).where("block_number > 0")
    return swaps.withColumns({name: text for name in ("amount0", "amount1", "amount_usd")})


@query
def wide_values(spark, folder):
    return filters.with_exact_values(_wide(spark, folder)).select("tx_hash", "usd_exact", "abs_amount0_exact", "abs_amount1_exact")


@query
def wide_value_range(spark, folder):
    """Bounds that no decimal holds: above half of 1e-28, up to 5000e40."""
    return filters.by_value_range(_wide(spark, folder), Decimal("0.5e-28"), Decimal("5000e40")).select("tx_hash", "amount_usd")


@query
def wide_sums_by_pool(spark, folder):
    """Sums of 40 digits and of 30 places; the negative ones apart."""
    signed = _wide(spark, folder).where("block_number % 4 <> 1").withColumn("negative", F.col("block_number") % 4 == 0)
    return wide_sums(signed, ["pool", "negative"], "amount_usd")


# --- cleaning in one pass -----------------------------------------------------------------------


def _stored_raw(spark: SparkSession, folder: str, df: DataFrame) -> str:
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    parquet.write_table(df, path)
    return path


@query
def cleaning_report(spark, folder):
    """The numbers of the page on a cleaning run of a table without ``recipient``; that column is an error in every row."""
    raw = _stored_raw(spark, folder, _raw(spark, folder).drop("recipient"))
    out = f"{shared_folder(spark)}/clean-{uuid.uuid4().hex}"
    outcome = jobs.clean_job(spark, raw, jobs.CleanPaths(f"{out}/swaps", f"{out}/report"))
    checked = outcome.checked
    facts = [
        ("rows", "total", float(checked.total_records)),
        ("rows", "valid", float(checked.valid_records)),
        ("rows", "invalid", float(checked.invalid_records)),
        ("rows", "duplicates", float(outcome.duplicates)),
        ("rows", "removed", float(outcome.removed)),
        *[("missing", name, 1.0) for name in checked.missing],
        *[(name, what, value) for name, n, low, high, _ in checked.numbers for what, value in (("n", float(n)), ("min", low), ("max", high))],
        *[(name, "mean", round(mean, 4)) for name, _, _, _, mean in checked.numbers],
    ]
    return spark.createDataFrame(facts, "section string, name string, value double")


@query
def cleaned_by_job(spark, folder):
    """Valid rows with blanks and capitals planted: they are handed on without."""
    padded = _raw(spark, folder).withColumns(
        {name: F.concat(F.lit(" "), F.col(name), F.lit("  ")) for name in ("pool", "sender", "tx_hash", "amount_usd", "timestamp")}
    )
    out = f"{shared_folder(spark)}/clean-{uuid.uuid4().hex}"
    paths = jobs.CleanPaths(f"{out}/swaps", f"{out}/report", f"{out}/rejected")
    jobs.clean_job(spark, _stored_raw(spark, folder, padded), paths, min_usd=5000.0)
    return parquet.read_swaps(spark, f"{out}/swaps").drop("day")


@query
def strict_cleaning(spark, folder):
    """Whether strict cleaning raises, for the raw table and for its valid rows, and the rows written either way."""
    raw = _raw(spark, folder)
    valid, _ = quality.quarantine(quality.with_swap_errors(raw))
    parts = None
    for name, table in (("raw", raw), ("valid", valid)):
        path = _stored_raw(spark, folder, table)
        out = f"{shared_folder(spark)}/strict-{uuid.uuid4().hex}"
        try:
            jobs.clean_job(spark, path, jobs.CleanPaths(f"{out}/swaps", f"{out}/report"), strict=True)
            raised = False
        except jobs.InvalidRows:
            raised = True
        part = parquet.read_swaps(spark, f"{out}/swaps").agg(F.count(F.lit(1)).alias("written"))
        part = part.select(F.lit(name).alias("input"), F.lit(raised).alias("raised"), "written")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query
def required_columns(spark, folder):
    """Columns that the detectors miss in a table without two of them, and the rows that cannot be used."""
    narrow = _swaps(spark, folder).drop("sender", "amount_usd")
    return quality.unusable_rows(narrow, {"sandwich": SANDWICH_INPUT, "wash": WASH_INPUT, "time range": ["pool", "timestamp"]})


@query
def text_order_keys(spark, folder):
    """Blocks as text, and many swaps at one time: their order is that of the numbers, not of the letters."""
    swaps = _swaps(spark, folder)
    shared = F.floor(F.col("timestamp") / 21600) * 21600
    as_text = swaps.withColumns({"timestamp": shared, "block_number": F.col("block_number").cast("string")})
    return sandwich_candidates(as_text, SANDWICH)


@query
def dedup_by_number(spark, folder):
    """Copies whose blocks have different numbers of digits: the smaller number stays."""
    swaps = _swaps(spark, folder)
    later = swaps.withColumn("block_number", F.concat(F.lit("1"), F.lpad(F.col("block_number").cast("string"), 9, "0")))
    both = swaps.withColumn("block_number", F.concat(F.lit("9"), F.lpad(F.col("block_number").cast("string"), 7, "0"))).unionByName(later)
    return cleaning.dedup_swaps(both).select("tx_hash", "block_number")


# --- statistics per pool, several addresses ------------------------------------------------------


@query
def robust_z_all(spark, folder):
    scored = robust_z(_swaps(spark, folder), ["pool"], "amount_usd")
    return _rounded(scored.select("tx_hash", "robust_z"), "robust_z")


@query
def robust_z_hot_pool(spark, folder):
    """A third of all swaps in one pool, and many equal amounts."""
    swaps = _swaps(spark, folder)
    hot = F.when(F.col("block_number") % 3 == 0, F.lit("0x" + "9" * 40)).otherwise(F.col("pool"))
    usd = F.when(F.col("block_number") % 5 == 0, F.lit(5000).cast("decimal(20,2)")).otherwise(F.col("amount_usd"))
    scored = robust_z(swaps.withColumns({"pool": hot, "amount_usd": usd}), ["pool"], "amount_usd")
    return _rounded(scored.select("tx_hash", "robust_z"), "robust_z")


def _paid_on(spark: SparkSession, folder: str) -> DataFrame:
    """Swaps of ten addresses a pool, each paying another one, as the number of the event says."""
    swaps = _swaps(spark, folder)
    address = lambda n: F.concat(F.lit("0x"), F.lpad(n.cast("string"), 40, "0"))
    b = F.col("block_number")
    return swaps.withColumns({"sender": address(b % 10), "recipient": address(F.floor(b / 10) % 10)})


LOOPS = collusion.LoopSettings(43200, Decimal("500"), 0.6, 4)


@query
def closed_loops(spark, folder):
    loops = collusion.closed_loops(_paid_on(spark, folder), LOOPS)
    return loops.select("pool", "addresses", "txs", "first_timestamp", "last_timestamp", "volume")


@query
def closed_loops_split(spark, folder):
    """The same with every join key cut into tiles."""
    small = collusion.LoopSettings(43200, Decimal("500"), 0.6, 4, pairs_per_task=16)
    return collusion.closed_loops(_paid_on(spark, folder), small).select("pool", "txs")


@query
def closed_loop_patterns(spark, folder):
    checked = quality.with_pattern_errors(collusion.loop_patterns(_paid_on(spark, folder), LOOPS))
    broken = F.size(quality.ERRORS) > 0
    return checked.groupBy("detection_type", "metrics.trade_count", "metrics.unique_addresses").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("n_broken")
    )


@query
def coordinated_groups(spark, folder):
    return collusion.coordinated_groups(_swaps(spark, folder), collusion.GroupSettings(3600, Decimal("500"), 4))
