"""Exact dedup: Golomb-coded exchange of fingerprints, then byte verification of suspects.

1. Every document gets a 64-bit fingerprint of its text (A-Z lower-cased). The fingerprints of a sender (a
   block of documents that one task wrote to a staged table) are dealt to owners by value, sorted, each once,
   and each owner's part goes out as the Golomb-Rice code of its gaps, with a bit per fingerprint that the sender has several times.
2. An owner decodes what all senders sent it and returns to each a bitmap: which of its fingerprints occur
   more than once anywhere.
3. Only documents with such a fingerprint (suspects) send their text. Equal texts are found by grouping on the bytes.
   Copies collapse in the map tasks, so one group may hold a third of all rows.

Defined results: null text counts as empty; of equal texts the row with the largest id stays, an id of
null only if there is no other. Rows that repeat both id and text are copies like any other; ``kept`` is true for each
row with the id that stays. Different texts with one SHA-256 would be reported as an error, not merged. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import ascii_lower, pick, staged

#: Fingerprints that one owner gets at the most from one sender, about; it sizes the exchange, not the result.
PER_MESSAGE = 4096
#: Ids of suspects are broadcast up to this many (some 64 MB) and joined by shuffle beyond it; the rows are the same.
BROADCAST_IDS = 2_000_000


def rice_parameter(n: int, span: int) -> int:
    """Bits of the remainder: the mean gap is ``span / n``."""
    return max(0, int(span // max(n, 1)).bit_length() - 1)


def golomb_encode(values: np.ndarray, low: int, span: int) -> bytes:
    """Sorted uint64 values in [low, low + span): unary quotients and fixed remainders of their gaps."""
    k = rice_parameter(len(values), span)
    gaps = np.diff(values, prepend=np.uint64(low))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, rest.reshape(-1)])).tobytes()


def golomb_decode(code: bytes, n: int, low: int, span: int) -> np.ndarray:
    k = rice_parameter(n, span)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    first = int(ends[-1]) + 1 if n else 0
    rest = bits[first : first + n * k].reshape(n, k).astype(np.uint64)
    remainders = (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + remainders
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
        digests = [hashlib.sha256(t.as_buffer()).digest() for t in low]
        prints = np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints), pa.array([d.hex() for d in digests], pa.string())],
            names=["doc_id", "print", "text_sha256"],
        )


def _unsigned(prints: np.ndarray) -> np.ndarray:
    return np.asarray(prints, np.int64).view(np.uint64)


def _messages(owners: int):
    """Codes of one sender: a row per owner."""
    span = (1 << 64) // owners + 1

    def encode(key, table):
        # Each fingerprint once, with a bit for those that the sender has several times: a text that a third of all rows share is one number.
        values, counts = np.unique(_unsigned(table.column("print").to_numpy()), return_counts=True)
        whose = values // np.uint64(span)
        cuts = np.searchsorted(whose, np.arange(owners + 1, dtype=np.uint64))
        rows = [
            (key[0].as_py(), o, int(b - a), golomb_encode(values[a:b], o * span, span), np.packbits(counts[a:b] > 1).tobytes())
            for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
            if b > a
        ]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sender", "owner", "n", "code", "several"])

    return encode


def _answers(owners: int):
    """Bitmaps of one owner: a row per sender, a bit per fingerprint that it sent, in order: whether any other row has it too."""
    span = (1 << 64) // owners + 1

    def answer(key, table):
        low = key[0].as_py() * span
        senders, sizes = table.column("sender").to_numpy(), table.column("n").to_numpy()
        sent = [golomb_decode(c.as_py(), int(n), low, span) for c, n in zip(table.column("code"), sizes, strict=True)]
        several = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8))[: len(s)].astype(bool) for b, s in zip(table.column("several"), sent, strict=True)]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        twice = np.union1d(values[counts > 1], np.concatenate([s[m] for s, m in zip(sent, several, strict=True)]))
        maps = [np.packbits(np.isin(s, twice)).tobytes() for s in sent]
        return pa.table(
            [pa.array(senders, pa.int64()), pa.array([key[0].as_py()] * len(maps), pa.int32()), pa.array(maps, pa.binary())],
            names=["sender", "owner", "bitmap"],
        )

    return answer


def _suspects(owners: int):
    span = (1 << 64) // owners + 1

    def flag(key, rows, bitmaps):
        values, place = np.unique(_unsigned(rows.column("print").to_numpy()), return_inverse=True)
        whose = values // np.uint64(span)
        flags = np.zeros(len(values), bool)
        for owner, bits in zip(bitmaps.column("owner").to_pylist(), bitmaps.column("bitmap").to_pylist(), strict=True):
            a, b = np.searchsorted(whose, np.array([owner, owner + 1], np.uint64))
            flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a].astype(bool)
        return rows.select(["doc_id", "print", "text_sha256"]).append_column("suspect", pa.array(flags[place]))

    return flag


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = pick(docs, doc_id=id_column, text=text_column)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    printed = docs.mapInArrow(_fingerprints, f"doc_id {id_type}, print long, text_sha256 string")
    # A sender is what one task wrote; the table fixes which rows those are.
    printed = staged(printed.withColumn("sender", F.shiftrightunsigned(F.monotonically_increasing_id(), 33)), "prints")
    shape = printed.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("sender").alias("senders")).first()
    owners = max(1, -(-shape["n"] // (PER_MESSAGE * max(1, shape["senders"]))))
    owners = min(max(owners, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 20)
    messages = printed.select("sender", "print").groupBy("sender").applyInArrow(_messages(owners), "sender long, owner int, n int, code binary, several binary")
    answers = messages.groupBy("owner").applyInArrow(_answers(owners), "sender long, owner int, bitmap binary")
    flagged = (
        printed.groupBy("sender")
        .cogroup(answers.groupBy("sender"))
        .applyInArrow(_suspects(owners), f"doc_id {id_type}, print long, text_sha256 string, suspect boolean")
    )
    flagged = staged(flagged, "flagged")
    alone = flagged.where("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    suspects = flagged.where("suspect").select("doc_id", "text_sha256")
    # The bytes of the suspects only; equal texts meet as one row per map task.
    ids = suspects.select("doc_id").distinct()
    if flagged.where("suspect").count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    texts = texts.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    groups = texts.groupBy("text_sha256", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = staged(groups.select("text_sha256", "keep_id", "group_size"), "groups")
    # Byte verification: one text per SHA-256.
    if groups.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").limit(1).count():
        raise ValueError("two texts with one SHA-256")
    copies = suspects.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    everything = alone.unionByName(copies)
    return everything.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
