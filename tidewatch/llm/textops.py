"""Words of many texts at once, as numpy arrays over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled whole.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 places where they start; null counts as empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 places in that list where the texts start."""
    inside = ~SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[starts] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    first = np.flatnonzero(inside & (~before | new[:-1]))
    last = np.flatnonzero(inside & (~after | new[1:]))
    return first, last + 1, np.searchsorted(first, starts)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of mixed (byte, place in the word)."""
    if not len(first):
        return np.zeros(0, np.uint64)
    lengths = end - first
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    values = mix(data[np.repeat(first, lengths) + place].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(8)))
    return np.add.reduceat(values, starts)


def words_of(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as an Arrow array."""
    lengths = end - first
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    place = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], lengths)
    joined = data[np.repeat(first, lengths) + place]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(joined))])
