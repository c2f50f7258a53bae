"""Wash findings as nested pattern records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.wash import WashSettings, flagged_roundtrips
from tidewatch.schemas import WASH_PATTERN_SCHEMA


def wash_patterns(df: DataFrame, settings: WashSettings = WashSettings()) -> DataFrame:
    """One record per flagged trader with its transactions in order, as ``WASH_PATTERN_SCHEMA``.

    Only flagged traders are gathered: all their roundtrips lie within one time window.
    """
    flagged, legs = flagged_roundtrips(df, settings)
    ratio = F.try_divide(F.least("open_usd", "close_usd").cast("double"), F.greatest("open_usd", "close_usd").cast("double"))
    in_order = F.sort_array(
        F.collect_list(F.struct("open_timestamp", "row", F.array("open_tx", "close_tx").alias("txs")))
    )
    gathered = legs.groupBy("pool", F.col("sender").alias("trader")).agg(
        F.flatten(F.transform(in_order, lambda leg: leg["txs"])).alias("related_tx_hashes"),
        F.avg(ratio).alias("similarity"),
    )
    trades = (F.col("roundtrip_count") * 2).cast("bigint")
    return flagged.join(gathered, ["pool", "trader"]).select(
        F.lit("roundtrip").alias("detection_type"),
        F.col("trader").alias("primary_address"),
        F.array("trader").alias("involved_addresses"),
        "pool",
        F.lit(None).cast("string").alias("token_pair"),
        "related_tx_hashes",
        F.col("first_timestamp").alias("start_timestamp"),
        F.col("last_timestamp").alias("end_timestamp"),
        F.struct(
            trades.alias("trade_count"),
            F.lit(1).cast("bigint").alias("unique_addresses"),
            F.col("time_span_seconds").alias("time_window_seconds"),
            F.col("roundtrip_count").alias("round_trip_count"),
            (F.col("time_span_seconds") / (trades - 1)).alias("avg_trade_interval_seconds"),
            F.col("similarity").alias("amount_similarity_score"),
            F.col("total_volume_usd").cast("string").alias("volume_usd_total"),
            F.lit(None).cast("double").alias("counterparty_diversity"),
        ).alias("metrics"),
        "confidence_score",
        F.concat(
            F.lit("Address made "), F.col("roundtrip_count").cast("string"),
            F.lit(" roundtrip trades within "), F.col("time_span_seconds").cast("string"),
            F.lit(" seconds"),
        ).alias("description"),
    ).select(*WASH_PATTERN_SCHEMA.fieldNames())


def flat_patterns(patterns: DataFrame) -> DataFrame:
    """Flat table of pattern records; arrays become comma-separated text."""
    metrics = [
        "trade_count", "unique_addresses", "time_window_seconds", "round_trip_count",
        "avg_trade_interval_seconds", "amount_similarity_score", "volume_usd_total",
        "counterparty_diversity",
    ]
    return patterns.select(
        "detection_type",
        "primary_address",
        F.array_join("involved_addresses", ",").alias("involved_addresses"),
        "pool",
        "token_pair",
        F.array_join("related_tx_hashes", ",").alias("related_tx_hashes"),
        "start_timestamp",
        "end_timestamp",
        *[F.col(f"metrics.{name}") for name in metrics],
        "confidence_score",
        "description",
    )
