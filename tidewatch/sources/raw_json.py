"""Swap payloads as landed from a GraphQL endpoint, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.parsing import as_long

# Field names of a payload. Every leaf is text: unreadable numbers become null below instead
# of failing the record. ``pool`` is an object or a plain address; as text it holds either.
_LEAVES = [
    "id",
    "timestamp",
    "sender",
    "recipient",
    "amount0",
    "amount1",
    "amountUSD",
    "tick",
    "sqrtPriceX96",
    "pool",
    "blockNumber",
    "transactionHash",
]

PAYLOAD_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _LEAVES]
    + [
        T.StructField(
            "transaction",
            T.StructType(
                [T.StructField("id", T.StringType()), T.StructField("blockNumber", T.StringType())]
            ),
        )
    ]
)


def _first_filled(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(value, F.lit("")) for value in values])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed lines as text in ``value``."""
    return spark.read.text(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return parse_payloads(read_lines(spark, path))


def _objects(column: str) -> Column:
    """The objects of a line, one or an array of them; null where the line is neither."""
    return F.from_json(column, T.ArrayType(PAYLOAD_SCHEMA))


def _is_payload(element: Column) -> Column:
    """Whether an element has any field of a payload: null and ``{}`` have none and are no swap."""
    nested = [element["transaction"]["id"], element["transaction"]["blockNumber"]]
    return F.coalesce(*[element[name] for name in _LEAVES], *nested).isNotNull()


def parse_payloads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Payload columns from a text column of JSON objects. Blank and broken lines, and elements without any field of a
    payload, give no row (``broken_lines``).

    Through a generator each line is parsed once; a plain struct would be parsed again for every
    use of one of its fields, because projections are merged.
    """
    return lines.select(F.inline(F.filter(_objects(column), _is_payload)))


def broken_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that hold text but no JSON object, or an element that is no payload, as they are.

    A line with both kinds of elements is here as a whole, and its payloads are swaps all the same.
    """
    every = F.forall(_objects(column), _is_payload)
    return lines.where((F.trim(column) != "") & ~F.coalesce(every, F.lit(False))).select(F.col(column).alias("line"))


def normalise_payloads(payloads: DataFrame) -> DataFrame:
    """Flat swap rows in canonical column order."""
    pool = F.col("pool")
    pool_object = F.startswith(F.ltrim(pool), F.lit("{"))
    block = _first_filled(F.col("transaction.blockNumber"), F.col("blockNumber"))
    return payloads.select(
        as_long(F.col("timestamp")).alias("timestamp"),
        as_long(block).alias("block_number"),
        _first_filled(F.col("transaction.id"), F.col("transactionHash"), F.col("id")).alias("tx_hash"),
        F.when(
            pool_object,
            _first_filled(F.get_json_object(pool, "$.id"), F.get_json_object(pool, "$.address")),
        )
        .otherwise(_first_filled(pool))
        .alias("pool"),
        _first_filled(F.col("sender")).alias("sender"),
        _first_filled(F.col("recipient")).alias("recipient"),
        _first_filled(F.col("amount0")).alias("amount0"),
        _first_filled(F.col("amount1")).alias("amount1"),
        _first_filled(F.col("amountUSD")).alias("amount_usd"),
        as_long(F.col("tick")).try_cast("int").alias("tick"),
        _first_filled(F.col("sqrtPriceX96")).alias("sqrtPriceX96"),
    )
