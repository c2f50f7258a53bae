"""Sandwich detection: a three-way range join of the swap table with itself.

A triple is a front-run, a victim and a back-run of one pool, in this order, where one sender makes
the front- and the back-run in opposite directions, for similar amounts and within the time window,
and another sender makes the victim trade. Every triple is kept, whatever the victim's direction.

Neither pools nor senders are a usable partition key on their own: one pool or one router can carry
most of the traffic. Both joins are hash joins on a time bucket as well, so the work of a key is
bounded by the traffic of a bucket, and keys with too many pairs are cut into tiles (``skew``).

A router that buys and sells all the time has as many triples as victims times pairs. ``sandwich_attacks``
gives one row per pair with the number and the volume of its victims instead. They are never listed: positions in the pool tell how
many swaps lie between the legs, positions among the attacker's own swaps how many of them are its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import trade_side
from tidewatch.functions.parsing import decimal_of, double_of, long_of, usd_of
from tidewatch.functions.scoring import amount_similarity, pair_points, profit_estimate, victim_points, with_triple_score
from tidewatch.operators.skew import TILE, grid_of, only_heavy, place_everywhere, place_left, place_right, tile_grid
from tidewatch.schemas import AMOUNT, SANDWICH_INPUT, SANDWICH_SCHEMA, require_columns
from tidewatch.session import written

#: Seconds of one pool that are sorted together to number its swaps.
PREFIX_SECONDS = 600

#: Tasks of the joins of heavy keys, and tiles into which all heavy keys are cut for pairs. Rows are repeated for tiles, so their
#: number is bounded: ``pairs_per_task`` is exceeded where it would ask for more.
HEAVY_TASKS, PAIR_TILES = 512, 128
#: Comparisons of a pair and a victim, and victims, for which triples get a task of their own.
TASK_PAIRS, TASK_ROWS = 1_000_000, 100_000


@dataclass(frozen=True)
class SandwichSettings:
    window_seconds: int = 60
    min_usd: float = 100.0
    similarity: float = 0.5
    # Pairs of rows of one join key that a single task may compare; None leaves skew to adaptive execution.
    pairs_per_task: int | None = 100_000_000

    def __post_init__(self) -> None:
        if self.window_seconds < 0:
            raise ValueError("window_seconds must not be negative")
        if self.pairs_per_task is not None and self.pairs_per_task <= 0:
            raise ValueError("pairs_per_task must be positive")

    @property
    def pair_bucket(self) -> int:
        """Twice the window: only fronts in the second half of a bucket need a second copy."""
        return max(1, 2 * self.window_seconds)

    @property
    def heavy_pair_bucket(self) -> int:
        """Half the window: three copies of a front, and buckets that are many enough to share the pairs."""
        return max(1, -(-self.window_seconds // 2))

    @property
    def victim_bucket(self) -> int:
        """A quarter of the window: the few pairs are repeated, the many victims are not."""
        return max(1, -(-self.window_seconds // 4))


def order_columns(df: DataFrame) -> list[str]:
    """Columns that put the swaps of a pool in one total order, independent of input order.

    Block number and log index count as numbers, also where they are stored as text: see ``swap_position``.
    """
    if {"block_number", "log_index"} <= set(df.columns):
        return ["block_number", "log_index", "tx_hash"]
    optional = ["block_number", "tx_hash", "amount0", "amount1"]
    return [name for name in optional if name in df.columns]


def swap_position(df: DataFrame) -> Column:
    """Time and order columns of a swap, to be compared as one value."""
    numbers = {"block_number", "log_index"}
    order = [long_of(df, name).alias(name) if name in numbers else F.col(name) for name in order_columns(df)]
    return F.struct(long_of(df, "timestamp").alias("ts"), *order)


def _bucket(seconds: Column, width: int) -> Column:
    return F.floor(seconds / F.lit(width))


def tradable_swaps(df: DataFrame, settings: SandwichSettings, exact: bool = False) -> DataFrame:
    """Swaps large enough to matter, narrowed to what the joins need.

    Columns: pool, sender, usd, side (-2 buy, 2 sell) and seq, the position within the pool. Time and
    hash are part of ``seq``; rows carry them once through the shuffles. With ``exact`` also exact_usd, a decimal.
    """
    require_columns(df, SANDWICH_INPUT)
    more = [decimal_of(df, "amount_usd", AMOUNT).alias("exact_usd")] if exact else []
    return df.select(
        "pool",
        "sender",
        usd_of(df).alias("usd"),
        trade_side(double_of(df, "amount0"), double_of(df, "amount1")).alias("side"),
        swap_position(df).alias("seq"),
        *more,
    ).where(
        (F.col("usd") >= float(settings.min_usd))
        & F.col("pool").isNotNull()
        & F.col("seq.ts").isNotNull()
    )


PAIR_KEY = ["pool", "sender", "bucket", "side"]
VICTIM_KEY = ["pool", "bucket"]


def _front_buckets(settings: SandwichSettings, width: int) -> Column:
    """Buckets of a front: its own and those that its window reaches."""
    seconds = F.col("seq.ts")
    return F.explode(F.sequence(_bucket(seconds, width), _bucket(seconds + settings.window_seconds, width)))


def _may_be_heavy(swaps: DataFrame, settings: SandwichSettings, sides: int) -> bool:
    """Whether some pool and bucket has so many swaps that a join of ``sides`` sides could exceed a task.

    One cheap count. Without such a bucket no finer key can be heavy and nothing else is counted.
    """
    if settings.pairs_per_task is None:
        return False
    counts = swaps.select("pool", _front_buckets(settings, settings.pair_bucket).alias("bucket")).groupBy("pool", "bucket").count()
    most = counts.agg(F.max("count")).first()[0] or 0
    return most**sides > settings.pairs_per_task


def _legs(swaps: DataFrame, settings: SandwichSettings, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fronts, backs) with the columns of ``PAIR_KEY``, in buckets of ``width`` seconds (``pair_bucket`` by default).

    Extra columns of ``swaps`` get the leg's name in front.
    """
    width = width or settings.pair_bucket
    extra = [name for name in swaps.columns if name not in ("pool", "sender", "side")]
    legs = swaps.where((F.abs("side") == 2) & F.col("sender").isNotNull())
    if settings.min_usd <= 0:
        legs = legs.where(F.col("usd") > 0)
    fronts = legs.select(
        "pool",
        "sender",
        (-F.col("side")).alias("side"),
        _front_buckets(settings, width).alias("bucket"),
        *[F.col(name).alias(f"front_{name}") for name in extra],
    )
    backs = legs.select(
        "pool",
        "sender",
        "side",
        _bucket(F.col("seq.ts"), width).alias("bucket"),
        *[F.col(name).alias(f"back_{name}") for name in extra],
    )
    return fronts, backs


def _pairs(swaps: DataFrame, settings: SandwichSettings, heavy: bool) -> DataFrame:
    fronts, backs = _legs(swaps, settings, settings.heavy_pair_bucket if heavy else settings.pair_bucket)
    grid = tile_grid(fronts, backs, PAIR_KEY, settings.pairs_per_task, PAIR_TILES) if heavy else None
    # A back lies in one bucket, so a pair meets once although fronts are repeated.
    left, right = place_left(fronts, grid, PAIR_KEY, "front_seq"), place_right(backs, grid, PAIR_KEY, "back_seq")
    key = _tiled(PAIR_KEY, grid)
    if heavy:
        # Small in bytes, not in pairs: a broadcast or few partitions would leave them to as few tasks as there are files.
        left, right = left.repartition(HEAVY_TASKS, *key), right.repartition(HEAVY_TASKS, *key).hint("merge")
    return _matched(left.join(right, key), settings)


def _tiled(keys: list[str], grid: DataFrame | None) -> list[str]:
    """Keys of a join with tiles. Columns that a plan knows to be constant are no keys to it: rows dealt by them would be shuffled again."""
    return keys if grid is None else keys + TILE


def _matched(joined: DataFrame, settings: SandwichSettings) -> DataFrame:
    """Of joined legs those that are a pair, with their similarity."""
    similarity = amount_similarity(F.col("front_usd"), F.col("back_usd"))
    return (
        joined.where(
            (F.col("front_seq") < F.col("back_seq"))
            & (F.col("back_seq.ts") - F.col("front_seq.ts") <= settings.window_seconds)
            & (similarity >= settings.similarity)
        )
        .withColumn("similarity", similarity)
    )


def reversal_pairs(df: DataFrame, settings: SandwichSettings = SandwichSettings()) -> DataFrame:
    """Opposite trades of one sender in one pool within the window: sandwiches without a victim."""
    swaps = tradable_swaps(df, settings)
    heavy = _may_be_heavy(swaps, settings, 2)
    return _pairs(written(swaps, "swaps") if heavy else swaps, settings, heavy).select(*_pair_columns(), "similarity")


def _pair_columns() -> list[Column]:
    return [
        F.col("pool"),
        F.col("sender").alias("attacker"),
        F.col("front_seq.tx_hash").alias("front_run_tx"),
        F.col("back_seq.tx_hash").alias("back_run_tx"),
        F.col("front_seq.ts").alias("front_run_timestamp"),
        F.col("back_seq.ts").alias("back_run_timestamp"),
        F.col("front_usd").alias("front_run_amount_usd"),
        F.col("back_usd").alias("back_run_amount_usd"),
    ]


def _counted(swaps: DataFrame, owner: list[str], prefix: str) -> DataFrame:
    """Adds for each swap how many of ``owner`` come before it and up to it, and their volumes.

    ``<prefix>before`` and ``<prefix>upto`` count, ``<prefix>volume_before`` and ``<prefix>volume_upto`` add up. Swaps are sorted
    within ``PREFIX_SECONDS``; what came earlier is added per bucket. An owner has one row per bucket at most there, so its
    rows are bounded by the calendar.
    """
    key = [*owner, "count_bucket"]
    totals = swaps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.try_sum("exact_usd").alias("volume"))
    earlier = Window.partitionBy(*owner).orderBy("count_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *key,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier_n"),
        F.coalesce(F.try_sum("volume").over(earlier), F.lit(0).cast(AMOUNT)).alias("earlier_volume"),
    )
    order = Window.partitionBy(*key).orderBy("seq")
    # Swaps equal in time and order are neither before nor after each other.
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    local = swaps.withColumns(
        {
            "local_before": F.rank().over(order) - 1,
            "local_upto": F.count(F.lit(1)).over(order),
            "local_volume": F.try_sum("exact_usd").over(order),
            "peer_volume": F.try_sum("exact_usd").over(peers),
        }
    )
    volume = F.try_add("earlier_volume", "local_volume")
    return local.join(totals, key).select(
        *swaps.columns,
        (F.col("earlier_n") + F.col("local_before")).alias(f"{prefix}before"),
        (F.col("earlier_n") + F.col("local_upto")).alias(f"{prefix}upto"),
        F.try_subtract(volume, F.col("peer_volume")).cast(AMOUNT).alias(f"{prefix}volume_before"),
        volume.cast(AMOUNT).alias(f"{prefix}volume_upto"),
    )


def sandwich_attacks(df: DataFrame, settings: SandwichSettings = SandwichSettings()) -> DataFrame:
    """One row per pair of legs with a victim between them: the triples of ``sandwich_candidates``, counted.

    Columns: pool, attacker, front_run_tx, back_run_tx, front_run_timestamp, back_run_timestamp, front_run_amount_usd,
    back_run_amount_usd, similarity, profit_estimate_usd, victims, victim_volume_usd (exact; null above 38 digits).
    """
    swaps = tradable_swaps(df, settings, exact=True)
    heavy = _may_be_heavy(swaps, settings, 2)
    numbered = swaps.withColumn("count_bucket", _bucket(F.col("seq.ts"), PREFIX_SECONDS))
    legs = _counted(numbered, ["pool"], "").where(F.col("sender").isNotNull())
    # The position in the pool says what the other columns of the order do.
    legs = legs.withColumn("seq", F.struct("seq.ts", F.col("before").alias("position"), "seq.tx_hash")).drop("before")
    legs = _counted(legs, ["pool", "sender"], "own_")
    # Swaps of others, subtracted per swap: a pair takes one difference of each kind.
    legs = legs.select(
        "pool", "sender", "usd", "side", "seq",
        (F.col("seq.position") - F.col("own_before")).alias("others_before"),
        (F.col("upto") - F.col("own_upto")).alias("others_upto"),
        *[F.try_subtract(at, f"own_{at}").cast(AMOUNT).alias(f"others_{at}") for at in ("volume_before", "volume_upto")],
    )
    if heavy:
        # Numbered once for both legs.
        legs = written(legs, "legs")
    victims = F.col("back_others_before") - F.col("front_others_upto")
    return (
        _pairs(legs, settings, heavy)
        .withColumn("victims", victims)
        .where("victims > 0")
        .select(
            *_pair_columns(),
            "similarity",
            profit_estimate(F.col("front_usd"), F.col("back_usd")).alias("profit_estimate_usd"),
            "victims",
            F.try_subtract("back_others_volume_before", "front_others_volume_upto").cast(AMOUNT).alias("victim_volume_usd"),
        )
    )


def attacks_by_attacker(attacks: DataFrame) -> DataFrame:
    """Per attacker: pairs, victims (triples), pools, volume of all victims, largest profit."""
    pools = attacks.select("attacker", "pool").distinct().groupBy("attacker").agg(F.count(F.lit(1)).alias("pools"))
    totals = attacks.groupBy("attacker").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("victims").alias("victims"),
        F.try_sum("victim_volume_usd").cast(AMOUNT).alias("victim_volume_usd"),
        F.max("profit_estimate_usd").alias("largest_profit_usd"),
    )
    return totals.join(pools, "attacker")


def with_pair_values(pairs: DataFrame) -> DataFrame:
    """Pairs with what is the same for all their triples: profit estimate and the pair's part of the score."""
    span = F.col("back_seq.ts") - F.col("front_seq.ts")
    profit = profit_estimate(F.col("front_usd"), F.col("back_usd"))
    return pairs.withColumns({"profit": profit, "pair_points": pair_points(span, F.col("similarity"))})


def with_victim_values(victims: DataFrame) -> DataFrame:
    return victims.withColumn("victim_points", victim_points(F.col("victim_usd")))


def triple_columns(triples: DataFrame) -> DataFrame:
    """Joined legs (``with_pair_values``) and victims (``with_victim_values``) as ``SANDWICH_SCHEMA``."""
    return with_triple_score(triples, "confidence_score").select(
        F.col("sender").alias("attacker"),
        F.col("victim_seq.tx_hash").alias("victim_tx"),
        F.col("front_seq.tx_hash").alias("front_run_tx"),
        F.col("back_seq.tx_hash").alias("back_run_tx"),
        "pool",
        F.col("front_seq.ts").alias("front_run_timestamp"),
        F.col("victim_seq.ts").alias("victim_timestamp"),
        F.col("back_seq.ts").alias("back_run_timestamp"),
        F.col("front_usd").alias("front_run_amount_usd"),
        F.col("victim_usd").alias("victim_amount_usd"),
        F.col("back_usd").alias("back_run_amount_usd"),
        F.col("profit").alias("profit_estimate_usd"),
        "confidence_score",
    ).select(*SANDWICH_SCHEMA.fieldNames())


def _counts(fronts: DataFrame, backs: DataFrame, victims: DataFrame) -> DataFrame:
    """Of each pool and bucket the pairs of legs (``l``, counted per sender, not found) and the victims (``r``)."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = fronts.select(*PAIR_KEY, one.alias("f"), none.alias("b")).unionByName(backs.select(*PAIR_KEY, none.alias("f"), one.alias("b")))
    pairs = both.groupBy(*PAIR_KEY).agg(F.sum("f").alias("f"), F.sum("b").alias("b")).where("f > 0 AND b > 0")
    pairs = pairs.select(*VICTIM_KEY, (F.col("f") * F.col("b")).alias("l"), none.alias("r"))
    rows = pairs.unionByName(victims.select(*VICTIM_KEY, none.alias("l"), one.alias("r")))
    counts = rows.groupBy(*VICTIM_KEY).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return written(counts.where("l > 0 AND r > 0"), "pool-counts")


def _heavy_triples(swaps: DataFrame, settings: SandwichSettings) -> DataFrame:
    """Legs and victims meet by pool, the back's bucket of a window, and tiles: by the front, or the pair, and by the victim.

    A back lies in one bucket, and a front (a pair) and a victim each in one row and one column of its tiles, so a triple meets once.
    """
    width = max(1, settings.window_seconds)
    fronts, backs = _legs(swaps, settings, width)
    victims = with_victim_values(swaps.select("pool", _front_buckets(settings, width).alias("bucket"), *_victim_columns()))
    counts = _counts(fronts, backs, victims)
    grid = grid_of(counts, VICTIM_KEY, settings.pairs_per_task, HEAVY_TASKS)
    # Pairs grow with the square of the swaps: where they are more than victims, they are not worth a shuffle.
    kinds = {_streamed: counts.where("l > r"), _listed: counts.where("l <= r")}
    found = [meet for meet, keys in kinds.items() if keys.limit(1).count()] or [_listed]
    work = counts.agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("pairs"), F.sum("r").alias("rows")).first()
    tasks = 1 + min(HEAVY_TASKS, int((work.pairs or 0) // TASK_PAIRS)) + (work.rows or 0) // TASK_ROWS
    parts = [meet(*(only_heavy(side, kinds[meet], VICTIM_KEY) for side in (fronts, backs, victims)), grid, tasks, settings) for meet in found]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _streamed(fronts: DataFrame, backs: DataFrame, victims: DataFrame, grid: DataFrame | None, tasks: int, settings: SandwichSettings) -> DataFrame:
    """Pairs go from one join to the other as they are found: they are neither shuffled nor sorted nor written.

    Both joins have the same keys for that, so legs of all senders are compared, which is less than all pairs with all victims.
    """
    fronts = place_left(fronts.withColumnsRenamed({"sender": "front_sender", "side": "front_side"}), grid, VICTIM_KEY, "front_seq")
    backs, victims = place_everywhere(backs, grid, VICTIM_KEY), place_right(victims, grid, VICTIM_KEY, "victim_seq")
    key = _tiled(VICTIM_KEY, grid)
    fronts, backs, victims = (side.drop(*set(TILE) - set(key)).repartition(tasks, *key) for side in (fronts, backs, victims))
    # As bounds, since an equality would be a key.
    same_side, same_sender = ((F.col(f"front_{name}") <= F.col(name)) & (F.col(f"front_{name}") >= F.col(name)) for name in ("side", "sender"))
    met = fronts.join(backs.hint("merge"), key).where(same_side & same_sender).drop("front_sender", "front_side")
    return _with_victims(_matched(met, settings), victims, key)


def _listed(fronts: DataFrame, backs: DataFrame, victims: DataFrame, grid: DataFrame | None, tasks: int, settings: SandwichSettings) -> DataFrame:
    """Legs meet by sender; their pairs, at most as many as victims, are shuffled."""
    pairs = _matched(fronts.join(backs.hint("merge"), PAIR_KEY), settings).withColumn("pair", F.struct("front_seq", "back_seq"))
    pairs, victims = place_left(pairs, grid, VICTIM_KEY, "pair").drop("pair"), place_right(victims, grid, VICTIM_KEY, "victim_seq")
    key = _tiled(VICTIM_KEY, grid)
    pairs, victims = (side.drop(*set(TILE) - set(key)).repartition(tasks, *key) for side in (pairs, victims))
    return _with_victims(pairs, victims, key)


def _with_victims(pairs: DataFrame, victims: DataFrame, key: list[str]) -> DataFrame:
    pairs = with_pair_values(pairs).drop("side", "similarity")
    return pairs.join(victims.hint("merge"), key).drop("bucket", *TILE)


def _victim_columns() -> list[Column]:
    return [F.col("seq").alias("victim_seq"), F.col("sender").alias("victim_sender"), F.col("usd").alias("victim_usd")]


def _light_triples(swaps: DataFrame, settings: SandwichSettings) -> DataFrame:
    width = settings.victim_bucket
    pairs = with_pair_values(_pairs(swaps, settings, False)).drop("bucket", "side", "similarity", *TILE)
    buckets = F.sequence(_bucket(F.col("front_seq.ts"), width), _bucket(F.col("back_seq.ts"), width))
    pairs = pairs.withColumn("bucket", F.explode(buckets))
    victims = with_victim_values(swaps.select("pool", _bucket(F.col("seq.ts"), width).alias("bucket"), *_victim_columns()))
    # A victim lies in one bucket, so a triple meets once although pairs are repeated.
    return pairs.join(victims, VICTIM_KEY)


def sandwich_candidates(df: DataFrame, settings: SandwichSettings = SandwichSettings()) -> DataFrame:
    """All triples with profit estimate and score, as ``SANDWICH_SCHEMA``."""
    swaps = tradable_swaps(df, settings)
    heavy = _may_be_heavy(swaps, settings, 3)
    joined = _heavy_triples(written(swaps, "swaps"), settings) if heavy else _light_triples(swaps, settings)
    # A victim without a sender is somebody else's trade.
    triples = joined.where(
        (F.col("front_seq") < F.col("victim_seq"))
        & (F.col("victim_seq") < F.col("back_seq"))
        & ~F.col("victim_sender").eqNullSafe(F.col("sender"))
    )
    return triple_columns(triples)
