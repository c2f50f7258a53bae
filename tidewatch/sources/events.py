"""Swap tables derived from a plain event table (event_id, ts, user_id, event_type, value).

Event tables have no pools or hashes; the mapping gives each group of 150 users its own pools, so
the density of a pool stays the same at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import SWAP_COLUMNS


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _epoch_seconds() -> Column:
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def _hex_id(number: Column, width: int) -> Column:
    return F.concat(F.lit("0x"), F.lpad(number.cast("string"), width, "0"))


def events_as_swaps(events: DataFrame, traders: str = "attackers") -> DataFrame:
    """Canonical swap table with typed amounts. ``traders`` picks who trades: many users sharing few addresses over
    the whole time (``attackers``) or addresses that live for one day (``washers``)."""
    user = F.col("user_id")
    group = F.floor(user / 150)
    seconds = _epoch_seconds()
    if traders == "attackers":
        sender = group * 100000 + user % 20
    elif traders == "washers":
        sender = F.floor(user / 20) * 1000 + F.floor(seconds / 86400) % 1000
    else:
        raise ValueError(f"unknown traders: {traders}")
    value = F.col("value").cast("decimal(18,2)")
    sign = (F.col("event_id") % 2 * 2 - 1).cast("decimal(1,0)")
    pool = F.substring(
        F.sha2(F.concat(F.col("event_type"), F.lit("-"), group.cast("string")), 256), 1, 40
    )
    return events.select(
        seconds.alias("timestamp"),
        F.col("event_id").alias("block_number"),
        _hex_id(F.col("event_id"), 64).alias("tx_hash"),
        F.concat(F.lit("0x"), pool).alias("pool"),
        _hex_id(sender, 40).alias("sender"),
        _hex_id(sender, 40).alias("recipient"),
        (value * sign).cast("decimal(18,2)").alias("amount0"),
        (value * sign * F.expr("-0.001")).cast("decimal(20,5)").alias("amount1"),
        (value * F.expr("100")).cast("decimal(20,2)").alias("amount_usd"),
        (F.col("event_id") % 1000).cast("int").alias("tick"),
        F.concat((F.col("event_id") % 500 + 79000).cast("string"), F.lit("0" * 24)).alias(
            "sqrtPriceX96"
        ),
    ).select(*SWAP_COLUMNS)


def plant_bad_rows(swaps: DataFrame) -> DataFrame:
    """The swap table as text with one kind of damage per ``block_number % 100`` of 1 to 11."""
    slot = F.col("block_number") % 100
    text = swaps.select(*[F.col(name).cast("string").alias(name) for name in swaps.columns], slot.alias("slot"))

    def damage(column: str, at: int, value: Column) -> Column:
        return F.when(F.col("slot") == at, value).otherwise(F.col(column))

    upper = {
        name: damage(name, 10, F.concat(F.lit("0x"), F.upper(F.expr(f"substring({name}, 3)"))))
        for name in ["sender", "recipient"]
    }
    upper["pool"] = F.when(F.col("slot") == 3, F.lit("0xinvalid")).otherwise(
        damage("pool", 10, F.concat(F.lit("0x"), F.upper(F.expr("substring(pool, 3)"))))
    )
    same_sign = F.regexp_replace("amount0", "^-", "")
    damaged = text.withColumns(
        {
            **upper,
            "timestamp": F.when(F.col("slot") == 1, F.lit("invalid"))
            .when(F.col("slot") == 2, F.lit("1000000"))
            .otherwise(F.col("timestamp")),
            "tx_hash": damage("tx_hash", 4, F.lit("invalid_hash")),
            "amount0": F.when(F.col("slot") == 5, F.lit("not_a_number")).otherwise(
                damage("amount0", 11, same_sign)
            ),
            "amount1": damage("amount1", 11, F.regexp_replace("amount1", "^-", "")),
            "tick": damage("tick", 6, F.lit("1000000")),
            "sqrtPriceX96": damage("sqrtPriceX96", 7, F.lit("-123")),
            "block_number": damage("block_number", 8, F.lit("-1")),
        }
    )
    copies = F.when(F.col("slot") == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return damaged.withColumn("copy", F.explode(copies)).drop("slot", "copy")


def swaps_as_payloads(swaps: DataFrame) -> DataFrame:
    """The swap table as JSON lines, in the payload shapes that occur (by ``block_number % 6``)."""
    shape = F.col("block_number") % 6
    pool_object = F.to_json(F.named_struct(F.lit("id"), F.col("pool")))
    pool_address = F.to_json(F.named_struct(F.lit("id"), F.lit(""), F.lit("address"), F.col("pool")))
    quote = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    pool = (
        F.when(shape == 1, quote(F.col("pool"))).when(shape == 2, pool_address).otherwise(pool_object)
    )
    nested = F.to_json(
        F.named_struct(F.lit("id"), F.col("tx_hash"), F.lit("blockNumber"), F.col("block_number").cast("string"))
    )
    flat = F.concat(
        F.lit(',"transactionHash":'), quote(F.col("tx_hash")),
        F.lit(',"blockNumber":'), quote(F.col("block_number").cast("string")),
    )
    where = (
        F.when(shape == 3, flat)
        .when(shape == 4, F.concat(F.lit(',"transaction":null'), flat))
        .otherwise(F.concat(F.lit(',"transaction":'), nested))
    )
    leaves = F.to_json(
        F.named_struct(
            F.lit("id"), F.concat(F.col("tx_hash"), F.lit("#0")),
            F.lit("timestamp"), F.when(shape == 5, F.lit("soon")).otherwise(F.col("timestamp").cast("string")),
            F.lit("sender"), F.when(shape == 5, F.lit("")).otherwise(F.col("sender")),
            F.lit("recipient"), F.col("recipient"),
            F.lit("amount0"), F.col("amount0"),
            F.lit("amount1"), F.col("amount1"),
            F.lit("amountUSD"), F.col("amount_usd"),
            F.lit("tick"), F.col("tick"),
            F.lit("sqrtPriceX96"), F.col("sqrtPriceX96"),
        )
    )
    body = F.rtrim(leaves, F.lit("}"))
    return swaps.select(F.concat(body, F.lit(',"pool":'), pool, where, F.lit("}")).alias("value"))
