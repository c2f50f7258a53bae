"""Best-fit packing of documents into sequences, under conflicts.

Two pieces of one source, or of one cluster of duplicates, never share a bin. Documents longer than a bin
are cut into pieces of full length and a rest, so no token is lost. Pieces are dealt to shards by hash; the number of shards follows
the number of pieces, so a shard stays a task of fixed size. Within a shard, pieces go in order of falling length. Open bins
are held in order of what they have left; each carries a bitmap of its sources and one of its clusters. The search starts at
the first bin that is large enough and moves on to its successors until one is compatible: the tightest
compatible bin. If none is, a new bin is opened.

Defined results: a null or empty text has no tokens and gives one row of length 0 without a bin; a null source or cluster
conflicts with nothing; rows that repeat are pieces of their own. Ties go by hash of id and text, then id. An empty table gives
no rows. Columns beside the named ones are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import WORD, pick, row_key, staged

CAPACITY = 2048
PIECES_PER_SHARD = 8192


class Bins:
    """Open bins in order of the room that is left."""

    def __init__(self, capacity: int, words: int):
        self.capacity = capacity
        self.room = np.empty(1024, np.int64)
        self.ids = np.empty(1024, np.int64)
        self.size = 0
        self.sources = np.zeros((1024, max(1, words)), np.uint64)
        self.clusters: list[int] = []

    def _insert(self, at: int, room: int, number: int) -> None:
        if self.size == len(self.room):
            self.room, self.ids = np.concatenate([self.room] * 2), np.concatenate([self.ids] * 2)
        self.room[at + 1 : self.size + 1] = self.room[at : self.size]
        self.ids[at + 1 : self.size + 1] = self.ids[at : self.size]
        self.room[at], self.ids[at] = room, number
        self.size += 1

    def _remove(self, at: int) -> None:
        self.room[at : self.size - 1] = self.room[at + 1 : self.size].copy()
        self.ids[at : self.size - 1] = self.ids[at + 1 : self.size].copy()
        self.size -= 1

    def _tightest(self, length: int, source: int, cluster: int) -> int:
        """Place in the order of the tightest bin that fits and is compatible, or -1."""
        word, bit = divmod(max(source, 0), 64)
        at, step = int(np.searchsorted(self.room[: self.size], length)), 16
        while at < self.size:
            bins = self.ids[at : min(at + step, self.size)]
            free = np.ones(len(bins), bool) if source < 0 else (self.sources[bins, word] >> np.uint64(bit)) & np.uint64(1) == 0
            for k in np.flatnonzero(free):
                if cluster < 0 or not self.clusters[bins[k]] >> cluster & 1:
                    return at + int(k)
            at, step = at + len(bins), step * 4
        return -1

    def place(self, length: int, source: int, cluster: int) -> int:
        """Number of the bin that takes the piece."""
        at = self._tightest(length, source, cluster)
        if at < 0:
            number, room = len(self.clusters), self.capacity
            self.clusters.append(0)
            if number == len(self.sources):
                self.sources = np.concatenate([self.sources, np.zeros_like(self.sources)])
        else:
            number, room = int(self.ids[at]), int(self.room[at])
            self._remove(at)
        if source >= 0:
            self.sources[number, source // 64] |= np.uint64(1 << source % 64)
        if cluster >= 0:
            self.clusters[number] |= 1 << cluster
        room -= length
        if room:
            self._insert(int(np.searchsorted(self.room[: self.size], room)), room, number)
        return number


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers for the values of a shard; -1 for null."""
    codes = column.combine_chunks().dictionary_encode()
    return codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def pack_shard(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece; the pieces come in order of falling length."""
    bins = Bins(capacity, int(sources.max(initial=-1)) // 64 + 1)
    values, counts = np.unique(clusters[clusters >= 0], return_counts=True)
    # A cluster with one piece in the shard conflicts with nothing.
    shared = {int(v): i for i, v in enumerate(values[counts > 1])}
    return np.array(
        [bins.place(int(n), int(s), shared.get(int(c), -1)) for n, s, c in zip(lengths, sources, clusters, strict=True)], np.int64
    )


def _packer(capacity: int):
    def pack(key, table):
        table = table.sort_by([("length", "descending"), ("k1", "ascending"), ("k2", "ascending"), ("piece", "ascending"), ("doc_id", "ascending")])
        number = pack_shard(table.column("length").to_numpy(), _codes(table.column("source")), _codes(table.column("cluster")), capacity)
        shard = np.full(len(number), key[0].as_py(), np.int64)
        order = np.argsort(number, kind="stable")
        lengths = table.column("length").to_numpy()[order]
        ends = np.cumsum(lengths)
        first = np.r_[True, np.diff(number[order]) != 0]
        offset = np.empty(len(number), np.int64)
        offset[order] = ends - lengths - np.maximum.accumulate(np.where(first, ends - lengths, 0))
        out = table.select(["doc_id", "piece", "start", "length"])
        for name, values in (("shard", shard), ("bin", number), ("bin_offset", offset)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return pack


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    cluster_column: str | None = None,
    capacity: int = CAPACITY,
    pieces_per_shard: int = PIECES_PER_SHARD,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length (in words), shard, bin, bin_offset.

    Without ``cluster_column`` the documents whose texts are equal but for letter case are a cluster.
    """
    cluster = F.col(f"`{cluster_column}`") if cluster_column else F.xxhash64(F.lower(F.col(f"`{text_column}`")))
    named = docs.withColumn("_cluster", cluster)
    rows = pick(named, doc_id=id_column, text=text_column, source=source_column, cluster="_cluster")
    measured = rows.select(
        "doc_id",
        *row_key("doc_id", "text"),
        F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("source"),
        F.when(F.col("cluster").isNotNull(), F.xxhash64("cluster")).alias("cluster"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n"),
    )
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity).cast("long"))
    pieces = measured.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
    pieces = pieces.withColumn("start", F.col("piece") * capacity)
    pieces = staged(pieces.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start"))).drop("n"), "pieces")
    shards = max(1, -(-pieces.where("length > 0").count() // pieces_per_shard))
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, piece long, start long, length long, shard long, bin long, bin_offset long"
    full = pieces.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("k1", "k2", "piece", "doc_id"), F.lit(shards)))
    packed = full.groupBy("shard").applyInArrow(_packer(capacity), schema)
    nothing = [F.lit(None).cast("long").alias(c) for c in ("shard", "bin", "bin_offset")]
    return packed.unionByName(pieces.where("length <= 0").select("doc_id", "piece", "start", "length", *nothing))
