"""Wash-trade detection: repeated buy-sell roundtrips of one trader in one pool.

Adjacent trades of a trader form an edge when they go in opposite directions, are close in time and
both large enough. Edges are paired off greedily from the left: a pair uses up both of its trades.
Within a run of consecutive edges that means the first, third, fifth ... edge is a roundtrip, so
the pairing is a matter of positions and needs window functions only.

One trader can hold a large part of the table (a router contract in the main pool), so a window over
(pool, trader) could put all of it into one task. The windows here run over
(pool, trader, time chunk). Since an edge never spans more than the time window, a chunk that also
sees the first ``window`` seconds after its end knows all edges that start in it. A run may go on
over chunk borders; then only the parity of its length has to be carried over, one row per chunk
in which that happens. Such rows are composed over a tree of chunks (``scan``). Windows are evaluated once:
the edges are written, then their small table of carried parities is joined.

Traders with too many trades in one chunk get chunks shorter than the time window. Repeating a whole
window of trades would then be too much; the first trade of the trader's next chunk is enough, because
an edge leads to the very next trade only.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import wash_direction
from tidewatch.functions.parsing import decimal_of, double_of, long_of
from tidewatch.functions.scoring import price_dispersion, sqrt_price_to_price, wash_confidence
from tidewatch.operators.scan import carried_bits
from tidewatch.operators.skew import heavy_keys, only_heavy
from tidewatch.schemas import AMOUNT, USD, WASH_INPUT, WASH_SCHEMA, require_columns
from tidewatch.session import written

TRADER = ["pool", "sender"]
CHUNK = TRADER + ["chunk"]


@dataclass(frozen=True)
class WashSettings:
    window_seconds: int = 300
    min_usd: Decimal = Decimal("1000")
    min_roundtrips: int = 3
    # Length of a time chunk in windows. Longer chunks repeat fewer trades at their borders,
    # shorter ones split a busy trader into more tasks.
    windows_per_chunk: int = 8
    # Trades of one trader and chunk that a single task may sort; None never splits a chunk.
    rows_per_task: int | None = 1_000_000

    def __post_init__(self) -> None:
        if self.window_seconds <= 0 or self.min_roundtrips <= 0 or self.windows_per_chunk <= 0:
            raise ValueError("window_seconds, min_roundtrips and windows_per_chunk must be positive")

    @property
    def chunk_seconds(self) -> int:
        return self.window_seconds * self.windows_per_chunk

    @property
    def short_chunk_seconds(self) -> int:
        return max(1, self.window_seconds // 10)


def _chunk(seconds: Column) -> Column:
    """Number of the chunk; ``width`` is its length, the same for all trades of a trader."""
    return F.floor(seconds / F.col("width"))


def _trades(df: DataFrame) -> DataFrame:
    require_columns(df, WASH_INPUT)
    sqrt_price = F.col("sqrtPriceX96") if "sqrtPriceX96" in df.columns else F.lit(None).cast("string")
    extra = [long_of(df, name).alias(name) for name in ["block_number", "log_index"] if name in df.columns]
    return df.select(
        "pool",
        "sender",
        long_of(df, "timestamp").alias("ts"),
        *extra,
        "tx_hash",
        double_of(df, "amount0").alias("amount0"),
        decimal_of(df, "amount_usd", USD).alias("usd"),
        sqrt_price_to_price(sqrt_price).alias("price"),
    ).where(F.col("pool").isNotNull() & F.col("sender").isNotNull() & F.col("ts").isNotNull())


def _busy_traders(trades: DataFrame, settings: WashSettings) -> DataFrame | None:
    """Traders with a chunk above the limit, None without any. A cheap count per pool comes first."""
    limit = settings.rows_per_task
    if limit is None:
        return None
    rows = trades.select(*TRADER, F.floor(F.col("ts") / F.lit(settings.chunk_seconds)).alias("chunk"))
    pools = heavy_keys(rows, ["pool", "chunk"], limit)
    if pools is None:
        return None
    busy = heavy_keys(only_heavy(rows, pools, ["pool", "chunk"]), CHUNK, limit)
    return None if busy is None else busy.select(*TRADER).distinct()


def _chunked(trades: DataFrame, order: list[str], settings: WashSettings) -> DataFrame:
    """Trades by chunk, each chunk followed by the trades after its end that an edge may lead to."""
    window = settings.window_seconds
    busy = _busy_traders(trades, settings)

    def long_chunks(some: DataFrame) -> DataFrame:
        some = some.withColumn("width", F.lit(settings.chunk_seconds))
        chunks = F.sequence(_chunk(F.col("ts") - window), _chunk(F.col("ts")))
        return some.withColumn("chunk", F.explode(chunks))

    if busy is None:
        return long_chunks(trades)
    short = (
        trades.join(busy, TRADER, "left_semi")
        .withColumn("width", F.lit(settings.short_chunk_seconds))
        .withColumn("chunk", _chunk(F.col("ts")))
    )
    # A chunk's first trade goes to the chunks before it from which an edge may lead to it, and each of those takes the
    # earliest it gets. Minima are combined map-side; a chunk without trades of its own ends up with one row and no edge.
    first = short.groupBy(*CHUNK, "width").agg(F.min(F.struct(*order)).alias("first"))
    reach = -(-window // settings.short_chunk_seconds) + 1
    behind = F.explode(F.sequence(F.col("chunk") - reach, F.col("chunk") - 1))
    ahead = (
        first.select(*TRADER, "width", "first", behind.alias("chunk"))
        .groupBy(*CHUNK, "width")
        .agg(F.min("first").alias("first"))
        .select(*TRADER, "first.*", "width", "chunk")
    )
    return (
        long_chunks(trades.join(busy, TRADER, "left_anti"))
        .unionByName(short)
        .unionByName(ahead)
    )


def _edges(df: DataFrame, settings: WashSettings) -> DataFrame:
    """Edges with their position in the run, counted from the start of the chunk at the earliest.

    ``open_run`` marks runs that began at the first trade of the chunk: they may continue one from
    the chunk before.
    """
    trades = _trades(df)
    # Every column takes part in the order. That makes it total, and it makes all uses of the
    # edges ask for the same columns, so that Spark shuffles the trades once and reuses the result.
    order = [name for name in trades.columns if name not in TRADER]
    repeated = _chunked(trades, order, settings)
    in_order = Window.partitionBy(*CHUNK).orderBy(*order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    minimum = F.lit(str(settings.min_usd)).cast(USD)
    is_edge = F.coalesce(
        (wash_direction(F.col("amount0")) != wash_direction(F.col("next.amount0")))
        & (F.col("next.ts") - F.col("ts") <= settings.window_seconds)
        & (F.col("usd") >= minimum)
        & (F.col("next.usd") >= minimum),
        F.lit(False),
    )
    follower = F.struct("ts", "tx_hash", "amount0", "usd")
    return (
        repeated.withColumns(
            {
                "next": F.lead(follower).over(in_order),
                "row": F.row_number().over(in_order),
            }
        )
        # Without a follower the struct is null, and so is the test of each of its fields.
        .withColumn("is_edge", F.col("next").isNotNull() & is_edge)
        .withColumn("last_break", F.max(F.when(~F.col("is_edge"), F.col("row"))).over(so_far))
        .where(F.col("is_edge") & (F.col("chunk") == _chunk(F.col("ts"))))
        .withColumn("open_run", F.col("last_break").isNull())
        .withColumn("position", F.col("row") - F.coalesce(F.col("last_break"), F.lit(0)))
    )


def _carried(edges: DataFrame) -> DataFrame:
    """Chunks into which a run of odd length reaches, as (pool, sender, chunk, carry)."""
    into = _chunk(F.col("next.ts"))
    odd = F.col("position") % 2
    crossing = edges.where(into > F.col("chunk")).select(
        *CHUNK,
        into.alias("into"),
        odd.cast("int").alias("out0"),
        # A run that was open at the chunk's start goes on counting from what came in.
        F.when(F.col("open_run"), 1 - odd).otherwise(odd).cast("int").alias("out1"),
    )
    return carried_bits(crossing, TRADER).withColumn("carry", F.lit(1))


def consecutive_pairs(df: DataFrame, settings: WashSettings = WashSettings()) -> DataFrame:
    """Adjacent trades that qualify as a roundtrip, before overlapping ones are dropped."""
    return _edges(df, settings).select(*_leg_columns())


def _leg_columns() -> list[Column]:
    return [
        F.col("pool"),
        F.col("sender"),
        F.col("tx_hash").alias("open_tx"),
        F.col("next.tx_hash").alias("close_tx"),
        F.col("ts").alias("open_timestamp"),
        F.col("next.ts").alias("close_timestamp"),
        F.col("usd").alias("open_usd"),
        F.col("next.usd").alias("close_usd"),
        F.col("price").alias("open_price"),
        F.abs(
            F.try_divide(F.col("amount0"), F.when(F.col("next.amount0") != 0, F.col("next.amount0")))
        ).alias("amount_ratio"),
        F.col("row"),
    ]


def _roundtrips(df: DataFrame, settings: WashSettings) -> DataFrame:
    edges = written(_edges(df, settings), "edges")
    placed = edges.join(_carried(edges), CHUNK, "left")
    carry = F.when(F.col("open_run"), F.coalesce(F.col("carry"), F.lit(0))).otherwise(F.lit(0))
    return placed.where((F.col("position") + carry) % 2 == 1).select(*_leg_columns())


def roundtrips(df: DataFrame, settings: WashSettings = WashSettings()) -> DataFrame:
    """Non-overlapping roundtrips, one row each."""
    return _roundtrips(df, settings).drop("row")


def wash_trades(df: DataFrame, settings: WashSettings = WashSettings()) -> DataFrame:
    """One row per pool and trader whose roundtrips all fit in one window, as ``WASH_SCHEMA``."""
    return _flagged(_roundtrips(df, settings), settings)


def flagged_roundtrips(df: DataFrame, settings: WashSettings) -> tuple[DataFrame, DataFrame]:
    """(flagged traders, their roundtrips with ``row`` as order within a second)."""
    pairs = _roundtrips(df, settings)
    flagged = _flagged(pairs, settings)
    of_flagged = flagged.select("pool", F.col("trader").alias("sender"))
    return flagged, pairs.join(of_flagged, TRADER, "left_semi")


def _flagged(pairs: DataFrame, settings: WashSettings) -> DataFrame:
    # Within a second the row number tells the order: no chunk border splits a second.
    first = F.struct("open_timestamp", "row")
    per_trader = (
        pairs.groupBy("pool", F.col("sender").alias("trader"))
        .agg(
            F.count(F.lit(1)).alias("roundtrip_count"),
            F.min_by("open_tx", first).alias("first_tx"),
            F.max_by("close_tx", first).alias("last_tx"),
            F.min("open_timestamp").alias("first_timestamp"),
            F.max("close_timestamp").alias("last_timestamp"),
            F.sum(F.col("open_usd") + F.col("close_usd")).cast(AMOUNT).alias("total_volume_usd"),
            F.avg(F.col("close_timestamp") - F.col("open_timestamp")).alias("avg_roundtrip_time"),
            price_dispersion(F.col("open_price"), F.col("amount_ratio")).alias("price_variance"),
        )
    )
    span = F.col("last_timestamp") - F.col("first_timestamp")
    return (
        per_trader.where(
            (F.col("roundtrip_count") >= settings.min_roundtrips) & (span <= settings.window_seconds)
        )
        .withColumn("time_span_seconds", span)
        .withColumn(
            "confidence_score",
            wash_confidence(
                F.col("roundtrip_count"),
                F.col("price_variance"),
                F.col("avg_roundtrip_time"),
                settings.window_seconds,
            ),
        )
        .select(*WASH_SCHEMA.fieldNames())
    )
