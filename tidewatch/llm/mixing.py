"""Mixing of sources to target weights by a low-discrepancy schedule.

Every source gets a target, its share of the mix by weight. No source is repeated more than ``MAX_EPOCHS``
times: what a target exceeds that by is shared among the others again. The mix is a sequence of slots of
``BLOCK_TOKENS`` tokens each. Slot k stands at the golden-ratio point frac(k / phi) + and takes the source whose
part of the cumulative targets holds that point, so every stretch of the mix comes near the weights. A source's
documents are shuffled by hash, laid end to end (once per epoch) and cut into blocks of as many tokens; the source's
r-th slot takes its r-th block. Every piece of a document in the mix is one row. DataFrame functions only.

No group is as large as a source. Ranks and running sums are taken in two steps: within small blocks of slots or small
hash buckets of documents, and over one total per block or bucket. Rows that repeat are counted before they meet.
Only tables of one row per source are sorted in one task.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own, the last
one; rows that repeat are documents of their own, each with its own place; an empty table gives no rows. Columns
beside the three named ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import WORD, pick, staged

#: Tokens of a slot. A source's share differs from its target by a few blocks at most.
BLOCK_TOKENS = 32
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this many halves of all tokens: 150 %.
HALVES = 3
MAX_EPOCHS = 2
#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
SLOTS_PER_GROUP = 1 << 16
DOCUMENTS_PER_BUCKET = 2_000


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source, size and how many rows are equal in all three."""
    rows = pick(docs, doc_id=id_column, text=text_column, source=source_column)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return staged(rows.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, halves: int = HALVES, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, number (code-point order, null last), source_size, weight, target, low, high.

    ``low`` and ``high`` bound the source's part of the cumulative targets. A source is full if its limit is
    reached before the tokens that are left, shared by weight among those that are not full, run out. In order of
    limit / weight the full ones come first.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = totals.select("source", "source_size", (F.row_number().over(order) - 1).alias("number"))
    weight = F.get(F.array(*map(F.lit, weights)), F.col("number") % len(weights)).cast("long")
    limited = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * epochs)
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.sum("source_size").over(every) * halves / 2.0) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = limited.select("*", level.alias("level")).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "number", "level"))).over(every)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * shared["level"])
    found = levelled.select("source", "number", "source_size", "weight", target.alias("target"))
    up_to = Window.orderBy("number")
    return found.withColumn("high", F.sum("target").over(up_to)).withColumn("low", F.coalesce(F.lag("high").over(up_to), F.lit(0.0)))


def schedule(targets: DataFrame, total: float, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, number, rank): the source of every slot and the slot's rank among those of that source.

    Points and bounds of the sources meet cell by cell of a grid as fine as the number of sources, each point then
    finds its bounds. Ranks are row numbers within groups of neighbouring slots plus the counts of the groups before.
    """
    spark = targets.sparkSession
    cells = max(1024, targets.count())
    slots = spark.range(-(-int(total) // block_tokens)).select(F.col("id").alias("slot"))
    point = (F.col("slot") + 1) * GOLDEN
    at = (point - F.floor(point)) * F.lit(total)
    wide = F.lit(total / cells)
    slots = slots.select("slot", at.alias("at")).withColumn("cell", F.floor(F.col("at") / wide))
    parts = targets.where("high > low").select("number", "low", "high")
    # One cell more on either side, so that rounding never parts a point from its source.
    touched = F.sequence(F.floor(F.col("low") / wide) - 1, F.floor(F.col("high") / wide) + 1)
    parts = parts.withColumn("cell", F.explode(touched))
    last = targets.agg(F.max("high")).first()[0] or 0.0
    inside = (F.col("at") >= F.col("low")) & ((F.col("at") < F.col("high")) | (F.col("high") == last))
    drawn = slots.join(parts, "cell").where(inside).select("slot", "number")
    drawn = staged(drawn.withColumn("bunch", F.floor(F.col("slot") / SLOTS_PER_GROUP)), "mix-slots")
    counts = drawn.groupBy("number", "bunch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("number").orderBy("bunch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "bunch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    local = drawn.withColumn("local", F.row_number().over(Window.partitionBy("number", "bunch").orderBy("slot")) - 1)
    # Stored slots compress to little: by its size on disk a planner would broadcast what is large in memory.
    return local.hint("merge").join(counts, ["number", "bunch"]).select("slot", "number", (F.col("offset") + F.col("local")).alias("rank"))


def _hash() -> Column:
    """32 bits of a digest, for the order in which a source's documents follow each other."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(" "))), 1, 8), 16, 10).cast("long")


def placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each group of equal rows with the place of its first token on its source's shuffled line, ``start``."""
    buckets = -(-sizes.count() // DOCUMENTS_PER_BUCKET) or 1
    rows = sizes.join(targets.select(F.col("source").alias("_source"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("doc_id", "source", "size", "n", "number", "source_size", "target", _hash().alias("h"))
    rows = rows.withColumn("bucket", F.floor(F.col("h") * buckets / F.lit(1 << 32)))
    tokens = F.col("size") * F.col("n")
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("number", "bucket").agg(F.sum(tokens).alias("tokens"))
    totals = totals.select("number", "bucket", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(tokens).over(within), F.lit(0)))
    rows = rows.hint("merge").join(totals, ["number", "bucket"]).withColumn("start", F.col("offset") + F.col("before"))
    return staged(rows.select("doc_id", "source", "size", "n", "number", "source_size", "target", "start"), "mix-places")


def pieces(places: DataFrame, block_tokens: int = BLOCK_TOKENS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(number, rank, start, copy, epoch, first, words): the tokens of each row that lie in each block of its source."""
    full = places.where("size > 0")
    copies = full.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    turns = copies.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)])))
    begin = F.col("epoch") * F.col("source_size") + F.col("start") + F.col("copy") * F.col("size")
    laid = turns.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))
    one = F.lit(block_tokens).cast("long")
    ranks = F.sequence(F.floor(F.col("begin") / one), F.floor((F.col("end") - 1) / one))
    cut = laid.withColumn("rank", F.explode(ranks))
    first = F.greatest("begin", F.col("rank") * one)
    end = F.least("end", (F.col("rank") + 1) * one)
    return cut.select("number", "rank", "start", "copy", "epoch", (first - F.col("begin")).alias("first"), (end - first).alias("words"))


class Mix:
    """A mix of ``docs``: ``targets`` (per source), ``places`` (per document) and ``rows`` (the pieces of the slots)."""

    def __init__(
        self,
        docs: DataFrame,
        id_column: str = "doc_id",
        text_column: str = "text",
        source_column: str = "source",
        weights: tuple[int, ...] = WEIGHTS,
        block_tokens: int = BLOCK_TOKENS,
    ):
        sizes = measured(docs, id_column, text_column, source_column)
        self.targets = staged(source_targets(sizes, weights), "mix-targets")
        self.places = placed(sizes, self.targets)
        total = float(sizes.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0) * HALVES / 2
        self.block_tokens = block_tokens
        self.slots = schedule(self.targets, total, block_tokens)

    def rows(self) -> DataFrame:
        """(slot, number, epoch, start, copy, first, words): word ``first`` and the next ones of a document, in a slot."""
        return self.slots.hint("merge").join(pieces(self.places, self.block_tokens), ["number", "rank"]).drop("rank")

    def sequence(self) -> DataFrame:
        """The mix itself: slot, place in the slot, source, doc_id, first word and number of words."""
        named = self.places.where("size > 0").select("number", "start", "doc_id", "source")
        order = Window.partitionBy("slot").orderBy("epoch", "start", "copy")
        rows = self.rows().withColumn("place", F.row_number().over(order) - 1)
        return rows.join(named, ["number", "start"]).select("slot", "place", "source", "doc_id", "epoch", "first", "words")

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken, source."""
        # Documents with tokens start at different places of their source's line; empty ones are not in the mix.
        sums = self.rows().groupBy("number", "start", "copy").agg(F.sum("words").alias("taken"))
        copies = self.places.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        full = copies.where("size > 0").hint("merge").join(sums, ["number", "start", "copy"], "left")
        columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"]
        empty = copies.where("size <= 0").withColumn("taken", F.lit(None).cast("long"))
        return full.select(*columns).unionByName(empty.select(*columns))
