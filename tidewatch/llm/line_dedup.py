"""Dedup of lines that many documents share.

A staged table holds the line keys of each document as 128-bit hashes. Hash, document and position are
range-partitioned and sorted, so that a line that a third of all documents hold is split over
many partitions. Each partition streams its first occurrences, one per hash and document, and reduces them to one count per hash. Hashes of enough
documents meet the positions again, and each document gets back a keep bitmap, run-length coded,
instead of text. DataFrame functions only.

Defined results: a null or empty text is one empty line and is never dropped; an empty key is never
common. Rows equal in id and text are one document and all are returned; rows that share an id but
not the text count as one document, each with its own result. A null id counts as one document of
its own per text. Extra columns of the input are ignored by ``line_report`` and kept by ``drop_common_lines``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import BLANKS, ascii_lower, pick, row_key, staged

MIN_DOCUMENTS = 10


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """One row per different (id, text): its key, number of lines and the hashes of its line keys."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keys = F.transform(lines, line_key)
    hashes = F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    owner = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(11), "text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(*row_key("doc_id", "text"), owner.alias("owner"), hashes.alias("hashes"))


def first_occurrences(positions: DataFrame) -> DataFrame:
    """(h1, h2, owner, pos): the first position of each line in each document that holds it.

    Rows are range-partitioned by hash and document and sorted by position within them; the window takes that partitioning as it
    is and streams through the sorted rows.
    """
    dealt = positions.repartitionByRange("h1", "h2", "owner").sortWithinPartitions("h1", "h2", "owner", "pos")
    in_document = Window.partitionBy("h1", "h2", "owner").orderBy("pos")
    return dealt.withColumn("n", F.row_number().over(in_document)).where("n = 1").drop("n")


def common_lines(positions: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, n_documents, first_pos) of the keys that at least ``min_documents`` documents hold."""
    first = first_occurrences(positions)
    counts = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_documents"), F.min("pos").alias("first_pos"))
    return counts.where(F.col("n_documents") >= min_documents)


def keep_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(k1, k2, dropped): for each document that loses lines the runs of dropped positions.

    ``dropped`` is the run-length coded complement of the keep bitmap: structs (first, last), in order.
    """
    keyed = staged(keyed_lines(docs), "line-keys")
    rows = keyed.select("k1", "k2", "owner", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL")
    rows = rows.select("k1", "k2", "owner", "pos", "h.h1", "h.h2")
    common = staged(common_lines(rows.select("h1", "h2", "owner", "pos"), min_documents), "common-lines")
    hits = rows.join(common.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("d"))
    last = F.size("d") - 1
    starts = F.filter("d", lambda x, i: (i == 0) | (F.get(F.col("d"), i - 1) != x - 1))
    ends = F.filter("d", lambda x, i: (i == last) | (F.get(F.col("d"), i + 1) != x + 1))
    return hits.select("k1", "k2", F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("dropped"))


def drop_common_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """``docs`` with all columns, plus a struct ``line_dedup``, which must not be the name of one: n_lines, n_dropped, kept (text)."""
    return deduped_rows(docs, id_column, text_column, min_documents).select("row.*", "line_dedup")


def deduped_rows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(row, line_dedup): each row of ``docs`` as a struct, whatever its columns are called, and its result."""
    narrow = pick(docs, doc_id=id_column, text=text_column)
    bitmaps = keep_bitmaps(narrow, min_documents)
    k1, k2 = row_key("doc_id", "text")
    all_columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    left = docs.select(all_columns.alias("row"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    joined = left.select("row", "text", k1, k2).join(bitmaps, ["k1", "k2"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n_dropped = F.aggregate("dropped", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    before = F.concat(F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))), F.col("dropped"))
    # Kept runs lie between one dropped run and the next.
    kept = F.flatten(
        F.transform(
            before,
            lambda r, i: F.slice(
                F.col("lines"),
                r["last"] + 2,
                F.coalesce(F.get(F.col("dropped"), i)["first"], F.size("lines")) - r["last"] - 1,
            ),
        )
    )
    out = joined.withColumn("lines", lines)
    result = F.struct(
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
    return out.select("row", result.alias("line_dedup"))


def line_report(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    found = drop_common_lines(pick(docs, doc_id="doc_id", text="text"), min_documents=min_documents)
    return found.select(
        "doc_id",
        F.col("line_dedup.n_lines"),
        F.col("line_dedup.n_dropped"),
        F.sha2(F.col("line_dedup.kept"), 256).alias("kept_sha256"),
    )
