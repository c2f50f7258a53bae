"""Connected components of a large edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.llm.tables import release
from tidewatch.session import cut


def _cut(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges`` written, and what tells their set from another, taken as they are written."""
    seen = Observation()
    edges = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return edges, seen.get


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge to another.

    Each round hangs the neighbours of a node on the smallest of them, first those above the node and
    then those below. Minima are map-side aggregates and joins are by key, so the degree of a node is not
    bounded by a task. Rounds grow with the logarithm of the diameter; each is cut by ``checkpoint``. Joins are by
    sort and merge, so that a driver of many rounds collects no tables to broadcast.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = _cut(edges)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least.hint("merge"), "u")
        small = below.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges, after = _cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        # The rounds before are cut off, and so are their shuffles.
        release(edges.sparkSession)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
