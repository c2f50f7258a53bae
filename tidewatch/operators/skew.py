"""Splitting of join keys that hold too much work for one task.

A time-bucketed range join compares all rows of one side with all rows of the other that share a key, so
a key of a busy pool can be slow long before it is large in bytes, which is what adaptive execution looks
at. What counts is the product of the two sides. The pairs of a heavy key form a rectangle, which is cut into
tiles: a row of the left side is dealt to one row of tiles and repeated for each of its columns, a row of the right side to
one column and repeated for each of its rows. Every pair meets in exactly one tile, and the repetition is the least for tiles of that size.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

TILE = ["tile_row", "tile_column"]

# Up to this many heavy keys travel as a broadcast table (about 100 bytes each); more are joined.
MAX_BROADCAST_KEYS = 10_000


def _small_or_joined(heavy: DataFrame) -> DataFrame | None:
    """Keys of a written table, so they are counted once for both sides; their number decides how they travel."""
    found = heavy.limit(MAX_BROADCAST_KEYS + 1).count()
    if not found:
        return None
    return heavy if found > MAX_BROADCAST_KEYS else F.broadcast(heavy)


def heavy_keys(rows: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame | None:
    """Keys with more than ``rows_per_task`` rows; None if there are none. Counts are combined map-side."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _small_or_joined(written(counts.where(F.col("n") > rows_per_task).select(*keys), "heavy-keys"))


def only_heavy(rows: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(heavy.select(*keys), keys, "left_semi")


def tile_grid(left: DataFrame, right: DataFrame, keys: list[str], pairs_per_task: int, most: int | None = None) -> DataFrame | None:
    """Keys with more than ``pairs_per_task`` pairs and their numbers of tiles each way; None if there are none.

    Both sides are counted in one aggregate. Tiles are squares, or as wide as the shorter side.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*keys, one.alias("l"), none.alias("r")).unionByName(right.select(*keys, none.alias("l"), one.alias("r")))
    return grid_of(both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r")), keys, pairs_per_task, most)


def grid_of(counts: DataFrame, keys: list[str], pairs_per_task: int, most: int | None = None) -> DataFrame | None:
    """``tile_grid`` from the numbers of rows ``l`` and ``r`` of each key.

    Tiles repeat rows, the more the finer they are. With ``most`` they are at least as large as a ``most``-th of all
    pairs of heavy keys, so tiles are enough to share the work, and copies do not grow with the number of pairs.
    """
    pairs = F.col("l").cast("double") * F.col("r")
    heavy = written(counts.where(pairs > pairs_per_task).select(*keys, "l", "r"), "heavy-keys")
    if most:
        pairs_per_task = max(pairs_per_task, int((heavy.agg(F.sum(pairs)).first()[0] or 0) / most))
    side = isqrt(pairs_per_task)

    def splits(own: str, other: str) -> Column:
        cut = F.when(F.col(other) <= side, F.ceil(pairs / F.lit(float(pairs_per_task)))).otherwise(F.ceil(F.col(own) / F.lit(side)))
        return F.when(F.col(own) <= side, F.lit(1)).otherwise(cut).cast("int")

    return _small_or_joined(heavy.where(pairs > pairs_per_task).select(*keys, splits("l", "r").alias("rows"), splits("r", "l").alias("columns")))


def _placed(rows: DataFrame, grid: DataFrame | None, keys: list[str], own: str, other: str, identity: str) -> DataFrame:
    """Each row in one of ``own`` parts, by the hash of ``identity``, and in all of ``other``."""
    own_tile, other_tile = TILE if own == "rows" else TILE[::-1]
    if grid is None:
        return rows.withColumns({name: F.lit(0) for name in TILE})
    joined = rows.join(grid, keys, "left")
    part = F.pmod(F.xxhash64(identity, F.lit(own)), F.coalesce(F.col(own), F.lit(1))).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    return joined.withColumn(own_tile, part).withColumn(other_tile, parts).drop("rows", "columns")


def place_left(rows: DataFrame, grid: DataFrame | None, keys: list[str], identity: str) -> DataFrame:
    return _placed(rows, grid, keys, "rows", "columns", identity)


def place_right(rows: DataFrame, grid: DataFrame | None, keys: list[str], identity: str) -> DataFrame:
    return _placed(rows, grid, keys, "columns", "rows", identity)


def place_everywhere(rows: DataFrame, grid: DataFrame | None, keys: list[str]) -> DataFrame:
    """Each row in all tiles of its key: rows that meet what the others of a tile have found."""
    if grid is None:
        return rows.withColumns({name: F.lit(0) for name in TILE})
    for name, n in zip(TILE, ("rows", "columns"), strict=True):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return rows.join(grid.drop("rows", "columns"), keys, "left").withColumns({name: F.coalesce(name, F.lit(0)) for name in TILE})
