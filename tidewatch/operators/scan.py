"""Parity that runs carry from one time chunk into the next, by a tree instead of a window over a whole trader.

A run of edges that reaches over the end of a chunk makes one row: the chunk it leaves, the chunk it reaches ``into`` and how its
length is odd or even there. That depends on the run's parity at the chunk's start only if the run was open
there. So a row is a function of one bit, ``out0`` and ``out1``, and a group of neighbouring rows is such a function again: functions
are composed. Groups of ``FANOUT`` chunks are composed, then groups of groups; then each group hands its
members the bit they start with. No task sees more than ``FANOUT`` rows of a trader at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 64


def _after(state: Column, row: Column, bit: Column) -> Column:
    """The bit after ``row`` if ``bit`` comes out of ``state``: only a run that reaches into this chunk counts."""
    arrives = (state["into"] == row["chunk"]) & (bit == 1)
    return F.when(arrives, row["out1"]).otherwise(row["out0"])


def _composed(rows: Column) -> Column:
    """One function of the bit at the first chunk for all ``rows``, in order: struct into, out0, out1."""
    start = F.struct(F.get(rows, F.lit(0))["chunk"].alias("into"), F.lit(0).alias("out0"), F.lit(1).alias("out1"))
    return F.aggregate(
        rows,
        start,
        lambda s, r: F.struct(r["into"].alias("into"), _after(s, r, s["out0"]).alias("out0"), _after(s, r, s["out1"]).alias("out1")),
    )


def _bits(rows: Column, bit: Column) -> Column:
    """For each of ``rows`` the bit it starts with, from that of the first one."""
    member = "array<struct<chunk: bigint, member: bigint, bit: int>>"
    start = F.struct(F.get(rows, F.lit(0))["chunk"].alias("into"), bit.cast("int").alias("bit"), F.array().cast(member).alias("found"))

    def step(state, row):
        arrives = F.when((state["into"] == row["chunk"]) & (state["bit"] == 1), 1).otherwise(0)
        own = F.struct(row["chunk"].alias("chunk"), row["member"].alias("member"), arrives.alias("bit"))
        out = F.when(arrives == 1, row["out1"]).otherwise(row["out0"])
        return F.struct(row["into"].alias("into"), out.alias("bit"), F.array_append(state["found"], own).alias("found"))

    return F.aggregate(rows, start, step, lambda s: s["found"])


def carried_bits(rows: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """Keys and ``chunk`` into which a run of odd length reaches.

    ``rows`` has the keys, chunk (long), into, and out0 and out1: the parity that goes on if an even or odd one comes in.
    """
    low, high = rows.agg(F.min("chunk"), F.max("chunk")).first()
    if low is None:
        return rows.select(*keys, F.col("into").alias("chunk"))
    fields = ["chunk", "member", "into", "out0", "out1"]
    level = rows.select(*keys, "chunk", (F.col("chunk") - low).alias("member"), "into", "out0", "out1")
    levels, span = [], high - low
    while True:
        grouped = (
            level.withColumn("parent", F.floor(F.col("member") / fanout))
            .groupBy(*keys, "parent")
            .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))
        )
        levels.append(grouped)
        span //= fanout
        if span == 0:
            break
        whole = _composed(F.col("members"))
        first = F.get("members", F.lit(0))["chunk"].alias("chunk")
        level = grouped.select(*keys, first, F.col("parent").alias("member"), whole.alias("w")).select(*keys, "chunk", "member", "w.*")
    # From the top down: the first member of all starts with an even parity.
    bits = levels[-1].select(*keys, F.explode(_bits(F.col("members"), F.lit(0))).alias("b")).select(*keys, "b.member", "b.bit")
    for grouped in levels[-2::-1]:
        groups = grouped.join(bits.withColumnRenamed("member", "parent"), [*keys, "parent"])
        bits = groups.select(*keys, F.explode(_bits(F.col("members"), F.col("bit"))).alias("b")).select(*keys, "b.member", "b.bit")
    own = rows.withColumn("member", F.col("chunk") - low).join(bits, [*keys, "member"])
    out = F.when(F.col("bit") == 1, F.col("out1")).otherwise(F.col("out0"))
    return own.where(out == 1).select(*keys, F.col("into").alias("chunk"))
