"""Both detectors on a stream of swaps, in event time.

Sandwiches are two joins of the stream with itself, with time bounds on both, so their state is dropped
once the watermark has passed the window. Roundtrips need the trades of a trader in order: a keyed state holds those that
the watermark has not passed, and a timer walks through them once it has. What a replay of a table gives is what
the batch detectors give for it.

Late rows: a swap more than ``delay_seconds`` behind the latest one of the batches before is left out, as the watermark has passed
it; all others count, whatever their order. The watermark moves with the data: the last ``delay_seconds`` of a stream are
not walked through until later swaps arrive. Rows without a time are left out.

The state needs the RocksDB store (``state_settings``) and, for roundtrips, Python workers with pandas.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.labels import wash_direction
from tidewatch.operators.sandwich import (
    VICTIM_KEY,
    SandwichSettings,
    _bucket,
    _legs,
    amount_similarity,
    tradable_swaps,
    triple_columns,
    with_pair_values,
    with_victim_values,
)
from tidewatch.operators.wash import WashSettings, _trades
from tidewatch.schemas import USD

AT = "at"


def state_settings(spark: SparkSession) -> None:
    """Sets the state store that timers and large states need."""
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)


def _event_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def stream_sandwiches(swaps: DataFrame, settings: SandwichSettings = SandwichSettings(), delay_seconds: int = 60) -> DataFrame:
    """The triples of ``sandwich_candidates`` for a streaming table of typed swaps, as ``SANDWICH_SCHEMA``.

    A triple is given once, in the batch in which its last swap arrives.
    """
    window = F.expr(f"INTERVAL {settings.window_seconds} SECONDS")
    timed = tradable_swaps(swaps, settings).withColumn(AT, _event_time(F.col("seq.ts"))).withWatermark(AT, f"{delay_seconds} seconds")
    fronts, backs = _legs(timed, settings)
    key = ["pool", "sender", "bucket", "side"]
    fronts = fronts.select(*[F.col(c).alias(f"f_{c}") for c in key], "front_seq", "front_usd", "front_at")
    similarity = amount_similarity(F.col("front_usd"), F.col("back_usd"))
    same = [F.col(f"f_{c}") == F.col(c) for c in key]
    in_time = (F.col("front_at") <= F.col("back_at")) & (F.col("back_at") <= F.col("front_at") + window)
    ordered = (F.col("front_seq") < F.col("back_seq")) & (similarity >= settings.similarity)
    condition = in_time & ordered
    for equal in same:
        condition = condition & equal
    pairs = fronts.join(backs, condition).withColumn("similarity", similarity).drop(*[f"f_{c}" for c in key], "bucket", "side", "front_at")
    width = settings.victim_bucket
    buckets = F.sequence(_bucket(F.col("front_seq.ts"), width), _bucket(F.col("back_seq.ts"), width))
    pairs = pairs.withColumn("bucket", F.explode(buckets))
    victims = timed.select(
        F.col("pool").alias("v_pool"),
        _bucket(F.col("seq.ts"), width).alias("v_bucket"),
        F.col("seq").alias("victim_seq"),
        F.col("sender").alias("victim_sender"),
        F.col("usd").alias("victim_usd"),
        F.col(AT).alias("victim_at"),
    )
    between = (F.col("front_seq") < F.col("victim_seq")) & (F.col("victim_seq") < F.col("back_seq"))
    condition = (
        (F.col("victim_at") <= F.col("back_at"))
        & (F.col("back_at") <= F.col("victim_at") + window)
        & between
        & ~F.col("victim_sender").eqNullSafe(F.col("sender"))
    )
    for name in VICTIM_KEY:
        condition = condition & (F.col(f"v_{name}") == F.col(name))
    return triple_columns(with_pair_values(pairs).join(with_victim_values(victims), condition))


#: In the order in which trades of one trader follow each other.
_STATE = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("log_index", T.LongType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("amount0", T.DoubleType()),
        T.StructField("usd", USD),
        T.StructField("price", T.DoubleType()),
        T.StructField("side", T.StringType()),
    ]
)
_TS, _HASH, _AMOUNT, _USD, _PRICE, _SIDE = 0, 3, 4, 5, 6, 7
_ROUNDTRIP = T.StructType(
    [
        T.StructField("pool", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("open_tx", T.StringType()),
        T.StructField("close_tx", T.StringType()),
        T.StructField("open_timestamp", T.LongType()),
        T.StructField("close_timestamp", T.LongType()),
        T.StructField("open_usd", USD),
        T.StructField("close_usd", USD),
        T.StructField("open_price", T.DoubleType()),
        T.StructField("amount_ratio", T.DoubleType()),
    ]
)


def _rank(trade: tuple) -> tuple:
    """Position of a trade: all columns in order, nulls first."""
    return tuple((value is not None, value if value is not None else 0) for value in trade[:_SIDE])


class RoundtripProcessor(StatefulProcessor):
    """Pairs the trades of one trader in one pool from the left, in event time.

    ``pending`` holds the trades that the watermark has not passed, ``last`` the latest passed one that is in no pair. Idle traders
    leave no state: a timer drops ``last`` when nothing can pair with it any more.
    """

    def __init__(self, settings: WashSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _STATE)
        self.last = handle.getValueState("last", _STATE)

    def _timer(self, seconds: int) -> None:
        self.handle.registerTimer((seconds + 1) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        names = _STATE.fieldNames()
        for frame in rows:
            trades = list(frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None))
            self.pending.appendList(trades)
            for seconds in sorted({t[_TS] for t in trades}):
                self._timer(int(seconds))
        yield pd.DataFrame(columns=_ROUNDTRIP.fieldNames())

    def _pairs(self, opened: tuple, trade: tuple) -> bool:
        return (
            opened[_SIDE] != trade[_SIDE]
            and trade[_TS] - opened[_TS] <= self.settings.window_seconds
            and all(t[_USD] is not None and t[_USD] >= self.settings.min_usd for t in (opened, trade))
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        passed = expiredTimerInfo.getExpiryTimeInMs() // 1000
        trades = sorted((tuple(t) for t in self.pending.get()), key=_rank)
        ready = [t for t in trades if t[_TS] < passed]
        opened = tuple(self.last.get()) if self.last.exists() else None
        found = []
        for trade in ready:
            if opened and self._pairs(opened, trade):
                ratio = abs(opened[_AMOUNT] / trade[_AMOUNT]) if opened[_AMOUNT] is not None and trade[_AMOUNT] else None
                legs = [leg[column] for column in (_HASH, _TS, _USD) for leg in (opened, trade)]
                found.append((*key, *legs, opened[_PRICE], ratio))
                opened = None
            else:
                opened = trade
        if ready:
            rest = [t for t in trades if t[_TS] >= passed]
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
        if opened and passed > opened[_TS] + self.settings.window_seconds + 1:
            opened = None
        if opened:
            self.last.update(opened)
            self._timer(opened[_TS] + self.settings.window_seconds + 1)
        elif self.last.exists():
            self.last.clear()
        yield pd.DataFrame(found, columns=_ROUNDTRIP.fieldNames())

    def close(self) -> None:
        pass


def stream_roundtrips(swaps: DataFrame, settings: WashSettings = WashSettings(), delay_seconds: int = 60) -> DataFrame:
    """The roundtrips of ``roundtrips`` for a streaming table of typed swaps; a pair is given when the watermark passes its second trade."""
    trades = _trades(swaps)
    absent = [F.lit(None).cast("long").alias(c) for c in ("block_number", "log_index") if c not in trades.columns]
    side = wash_direction(F.col("amount0")).alias("side")
    timed = trades.select("*", *absent, side, _event_time(F.col("ts")).alias(AT)).withWatermark(AT, f"{delay_seconds} seconds")
    return timed.groupBy("pool", "sender").transformWithStateInPandas(
        statefulProcessor=RoundtripProcessor(settings),
        outputStructType=_ROUNDTRIP,
        outputMode="Append",
        timeMode="EventTime",
    )
