"""Wash trading by several addresses: closed loops and coordinated groups.

**Closed loop**: swaps of one pool, one after the other, in which each recipient sends the next swap and the last one pays
the first sender, over different addresses, within the time window and with similar amounts. Paths are grown hop by hop, up to a
number of swaps; each hop is a hash join on (pool, address, time bucket) whose heavy keys are cut into tiles. Times rise
along a loop, so each is found once, from its first swap.

**Coordinated group**: addresses that trade side by side again and again. Two addresses meet when they are neighbours, in the order of
addresses, among those that trade in one pool, one direction, one stretch of time and one size of amounts. That links an address to
two others per meeting, however many take part. Pairs that meet often enough are edges, and groups are their connected components.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import trade_direction
from tidewatch.functions.parsing import decimal_of, double_of, long_of
from tidewatch.operators.components import connected_components
from tidewatch.operators.sandwich import swap_position
from tidewatch.operators.skew import TILE, place_left, place_right, tile_grid
from tidewatch.schemas import AMOUNT, USD, WASH_PATTERN_SCHEMA, require_columns
from tidewatch.session import written

LOOP_KEY = ["pool", "address", "bucket"]


@dataclass(frozen=True)
class LoopSettings:
    window_seconds: int = 300
    min_usd: Decimal = Decimal("1000")
    #: Least ratio of the smallest to the largest amount of a loop.
    similarity: float = 0.9
    most_swaps: int = 4
    # Pairs of rows of one join key that a single task may compare; None leaves skew to adaptive execution.
    pairs_per_task: int | None = 100_000_000

    def __post_init__(self) -> None:
        if self.window_seconds <= 0 or self.most_swaps < 2:
            raise ValueError("window_seconds must be positive and most_swaps at least 2")


def _transfers(df: DataFrame, settings: LoopSettings) -> DataFrame:
    require_columns(df, ["timestamp", "tx_hash", "pool", "sender", "recipient", "amount_usd"])
    rows = df.select(
        "pool",
        "sender",
        "recipient",
        swap_position(df).alias("seq"),
        decimal_of(df, "amount_usd", USD).alias("usd"),
    )
    large = F.col("usd") >= F.lit(str(settings.min_usd)).cast(USD)
    return rows.where(large & (F.col("sender") != F.col("recipient")) & F.col("pool").isNotNull() & F.col("seq.ts").isNotNull())


def _grown(paths: DataFrame, swaps: DataFrame, settings: LoopSettings) -> DataFrame:
    """Paths with one more swap, closed or not. A swap lies in one bucket, a path in that of its end and the next one."""
    width, window = settings.window_seconds, settings.window_seconds
    ends = F.sequence(F.floor(F.col("last.ts") / width), F.floor((F.col("first.ts") + window) / width))
    left = paths.withColumn("bucket", F.explode(ends)).withColumnRenamed("at", "address")
    right = swaps.select(
        "pool", F.col("sender").alias("address"), F.floor(F.col("seq.ts") / width).alias("bucket"), "recipient", "seq", "usd"
    )
    grid = tile_grid(left, right, LOOP_KEY, settings.pairs_per_task) if settings.pairs_per_task else None
    joined = place_left(left, grid, LOOP_KEY, "last").join(place_right(right, grid, LOOP_KEY, "seq"), LOOP_KEY + TILE)
    low, high = F.least("low", "usd"), F.greatest("high", "usd")
    alike = F.try_divide(low.cast("double"), high.cast("double"))
    return joined.where(
        (F.col("seq") > F.col("last"))
        & (F.col("seq.ts") - F.col("first.ts") <= window)
        & (alike >= settings.similarity)
        & ((F.col("recipient") == F.col("addresses")[0]) | ~F.array_contains("addresses", F.col("recipient")))
    ).select(
        "pool",
        "first",
        F.col("seq").alias("last"),
        F.col("recipient").alias("at"),
        F.array_append("addresses", F.col("address")).alias("addresses"),
        F.array_append("txs", F.col("seq.tx_hash")).alias("txs"),
        low.alias("low"),
        high.alias("high"),
        (F.col("volume") + F.col("usd")).cast(AMOUNT).alias("volume"),
    )


def closed_loops(df: DataFrame, settings: LoopSettings = LoopSettings()) -> DataFrame:
    """One row per loop: pool, addresses and txs in order, first_timestamp, last_timestamp, low, high, volume (USD)."""
    swaps = written(_transfers(df, settings), "transfers")
    paths = swaps.select(
        "pool",
        F.col("seq").alias("first"),
        F.col("seq").alias("last"),
        F.col("recipient").alias("at"),
        F.array("sender").alias("addresses"),
        F.array("seq.tx_hash").alias("txs"),
        F.col("usd").alias("low"),
        F.col("usd").alias("high"),
        F.col("usd").cast(AMOUNT).alias("volume"),
    )
    found = None
    for hop in range(settings.most_swaps - 1):
        grown = _grown(paths, swaps, settings)
        back = F.col("at") == F.col("addresses")[0]
        if hop < settings.most_swaps - 2:
            # Counted, grown further and searched for loops: each hop is joined once.
            grown = written(grown, "paths")
        else:
            grown = grown.where(back)
        closed = grown.where(back)
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where(~back)
    return found.select(
        "pool", "addresses", "txs", F.col("first.ts").alias("first_timestamp"), F.col("last.ts").alias("last_timestamp"), "low", "high", "volume"
    )


def _record(kind: str, addresses: Column, txs: Column, pool: Column, first: Column, last: Column, volume: Column, alike: Column, text: Column):
    trades = F.size(txs).cast("bigint")
    unique = F.size(addresses).cast("bigint")
    span = last - first
    # More trades and more alike amounts make a finding surer.
    score = F.least(F.lit(1.0), F.lit(0.5) * alike + F.lit(0.5) * F.least(F.lit(1.0), trades / F.lit(10.0)))
    return [
        F.lit(kind).alias("detection_type"),
        addresses[0].alias("primary_address"),
        addresses.alias("involved_addresses"),
        pool.alias("pool"),
        F.lit(None).cast("string").alias("token_pair"),
        txs.alias("related_tx_hashes"),
        first.alias("start_timestamp"),
        last.alias("end_timestamp"),
        F.struct(
            trades.alias("trade_count"),
            unique.alias("unique_addresses"),
            span.alias("time_window_seconds"),
            F.lit(None).cast("bigint").alias("round_trip_count"),
            (span / F.greatest(trades - 1, F.lit(1))).alias("avg_trade_interval_seconds"),
            alike.alias("amount_similarity_score"),
            volume.cast("string").alias("volume_usd_total"),
            F.least(F.lit(1.0), unique / trades).alias("counterparty_diversity"),
        ).alias("metrics"),
        F.round(score, 4).alias("confidence_score"),
        text.alias("description"),
    ]


def loop_patterns(df: DataFrame, settings: LoopSettings = LoopSettings()) -> DataFrame:
    """Loops as ``WASH_PATTERN_SCHEMA``, of type closed_loop."""
    loops = closed_loops(df, settings)
    alike = F.try_divide(F.col("low").cast("double"), F.col("high").cast("double"))
    text = F.concat(F.size("txs").cast("string"), F.lit(" swaps lead back to "), F.col("addresses")[0])
    columns = _record(
        "closed_loop", F.col("addresses"), F.col("txs"), F.col("pool"), F.col("first_timestamp"), F.col("last_timestamp"), F.col("volume"), alike, text
    )
    return loops.select(*columns).select(*WASH_PATTERN_SCHEMA.fieldNames())


@dataclass(frozen=True)
class GroupSettings:
    #: Length of the stretch of time in which trades count as side by side.
    bucket_seconds: int = 60
    min_usd: Decimal = Decimal("1000")
    #: Amounts of one size share the power of two that they lie above.
    min_meetings: int = 3

    def __post_init__(self) -> None:
        if self.bucket_seconds <= 0 or self.min_meetings <= 0:
            raise ValueError("bucket_seconds and min_meetings must be positive")


def co_trading_edges(df: DataFrame, settings: GroupSettings = GroupSettings()) -> DataFrame:
    """pool, one, other, meetings: neighbouring addresses that meet often enough; ``one`` comes before ``other``."""
    require_columns(df, ["timestamp", "pool", "sender", "amount0", "amount1", "amount_usd"])
    usd = decimal_of(df, "amount_usd", USD)
    rows = df.select(
        "pool",
        "sender",
        trade_direction(double_of(df, "amount0"), double_of(df, "amount1")).alias("direction"),
        F.floor(long_of(df, "timestamp") / settings.bucket_seconds).alias("bucket"),
        # Binary digits of the whole part: exact, unlike a logarithm.
        F.length(F.bin(usd.cast("bigint"))).alias("size"),
        usd.alias("usd"),
    ).where((F.col("usd") >= F.lit(str(settings.min_usd)).cast(USD)) & F.col("pool").isNotNull() & F.col("sender").isNotNull())
    place = ["pool", "direction", "bucket", "size"]
    # Distinct first, combined map-side: a router's trades of a stretch are one row.
    present = rows.where("direction IS NOT NULL AND bucket IS NOT NULL").select(*place, "sender").distinct()
    neighbour = F.lead("sender").over(Window.partitionBy(*place).orderBy("sender"))
    pairs = present.select("pool", F.col("sender").alias("one"), neighbour.alias("other")).where("other IS NOT NULL")
    return pairs.groupBy("pool", "one", "other").agg(F.count(F.lit(1)).alias("meetings")).where(F.col("meetings") >= settings.min_meetings)


def coordinated_groups(df: DataFrame, settings: GroupSettings = GroupSettings()) -> DataFrame:
    """pool, address, group_id (least address of the group), group_size, meetings (of the group): one row per member.

    An address may belong to a group in each pool; groups of different pools are apart.
    """
    edges = co_trading_edges(df, settings)
    node = lambda name: F.struct("pool", F.col(name).alias("address"))
    members = connected_components(edges.select(node("one").alias("a"), node("other").alias("b")), "a", "b")
    members = members.select("node.pool", "node.address", F.col("component.address").alias("group_id"))
    sizes = members.groupBy("pool", "group_id").agg(F.count(F.lit(1)).alias("group_size"))
    of_edges = edges.join(members, (edges["pool"] == members["pool"]) & (edges["one"] == members["address"])).select(
        edges["pool"], "group_id", edges["meetings"].alias("n")
    )
    meetings = of_edges.groupBy("pool", "group_id").agg(F.sum("n").alias("meetings"))
    return members.join(sizes, ["pool", "group_id"]).join(meetings, ["pool", "group_id"]).select("pool", "address", "group_id", "group_size", "meetings")
