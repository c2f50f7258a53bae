"""Table schemas and the fixed values that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Canonical column order of the swap table.
SWAP_COLUMNS = [
    "timestamp",
    "block_number",
    "tx_hash",
    "pool",
    "sender",
    "recipient",
    "amount0",
    "amount1",
    "amount_usd",
    "tick",
    "sqrtPriceX96",
]

# Bounds of a legal swap record.
MIN_TIMESTAMP = 1438214400
MAX_TIMESTAMP = 2000000000
MAX_BLOCK = 100_000_000
MAX_TICK = 887272
ADDRESS_PATTERN = "^0x[a-f0-9]{40}$"
TX_HASH_PATTERN = "^0x[a-f0-9]{64}$"

# Columns that make a swap a copy of another one.
DEDUP_KEY = ["tx_hash", "timestamp", "sender", "recipient", "amount0", "amount1"]
DUPLICATE_COUNT_KEY = ["tx_hash", "timestamp", "sender", "recipient"]

ADDRESS_COLUMNS = ["pool", "sender", "recipient"]
AMOUNT_COLUMNS = ["amount0", "amount1"]
NUMBER_COLUMNS = ["timestamp", "block_number", "amount0", "amount1", "amount_usd", "tick"]

# Columns each detector needs.
SANDWICH_INPUT = ["timestamp", "pool", "sender", "tx_hash", "amount0", "amount1", "amount_usd"]
WASH_INPUT = ["timestamp", "tx_hash", "pool", "sender", "amount0", "amount_usd"]

# Kinds of wash pattern.
WASH_PATTERN_TYPES = ["roundtrip", "closed_loop", "coordinated"]

# Swap amounts carry 18 decimals. 36 digits leave room for the sum of two legs and for SUM itself.
USD = T.DecimalType(36, 18)
AMOUNT = T.DecimalType(38, 18)

#: Column that clean tables have beside the canonical ones: the USD amount, parsed.
TYPED_USD = "amount_usd_double"

_swap_types = {
    "timestamp": T.LongType(),
    "block_number": T.LongType(),
    "tick": T.IntegerType(),
}

SWAP_SCHEMA = T.StructType(
    [T.StructField(name, _swap_types.get(name, T.StringType())) for name in SWAP_COLUMNS]
)

# As landed: everything is text until it has been checked.
RAW_SWAP_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in SWAP_COLUMNS])

# Columns of the records below.
SANDWICH_SCHEMA = T.StructType(
    [
        T.StructField("attacker", T.StringType()),
        T.StructField("victim_tx", T.StringType()),
        T.StructField("front_run_tx", T.StringType()),
        T.StructField("back_run_tx", T.StringType()),
        T.StructField("pool", T.StringType()),
        T.StructField("front_run_timestamp", T.LongType()),
        T.StructField("victim_timestamp", T.LongType()),
        T.StructField("back_run_timestamp", T.LongType()),
        T.StructField("front_run_amount_usd", T.DoubleType()),
        T.StructField("victim_amount_usd", T.DoubleType()),
        T.StructField("back_run_amount_usd", T.DoubleType()),
        T.StructField("profit_estimate_usd", T.DoubleType()),
        T.StructField("confidence_score", T.DoubleType()),
    ]
)

WASH_SCHEMA = T.StructType(
    [
        T.StructField("trader", T.StringType()),
        T.StructField("pool", T.StringType()),
        T.StructField("roundtrip_count", T.LongType()),
        T.StructField("first_tx", T.StringType()),
        T.StructField("last_tx", T.StringType()),
        T.StructField("first_timestamp", T.LongType()),
        T.StructField("last_timestamp", T.LongType()),
        T.StructField("total_volume_usd", AMOUNT),
        T.StructField("avg_roundtrip_time", T.DoubleType()),
        T.StructField("price_variance", T.DoubleType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("time_span_seconds", T.LongType()),
    ]
)

WASH_METRICS_TYPE = T.StructType(
    [
        T.StructField("trade_count", T.LongType()),
        T.StructField("unique_addresses", T.LongType()),
        T.StructField("time_window_seconds", T.LongType()),
        T.StructField("round_trip_count", T.LongType()),
        T.StructField("avg_trade_interval_seconds", T.DoubleType()),
        T.StructField("amount_similarity_score", T.DoubleType()),
        T.StructField("volume_usd_total", T.StringType()),
        T.StructField("counterparty_diversity", T.DoubleType()),
    ]
)

WASH_PATTERN_SCHEMA = T.StructType(
    [
        T.StructField("detection_type", T.StringType()),
        T.StructField("primary_address", T.StringType()),
        T.StructField("involved_addresses", T.ArrayType(T.StringType())),
        T.StructField("pool", T.StringType()),
        T.StructField("token_pair", T.StringType()),
        T.StructField("related_tx_hashes", T.ArrayType(T.StringType())),
        T.StructField("start_timestamp", T.LongType()),
        T.StructField("end_timestamp", T.LongType()),
        T.StructField("metrics", WASH_METRICS_TYPE),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("description", T.StringType()),
    ]
)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that ``df`` lacks, sorted; looks at the schema only."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
