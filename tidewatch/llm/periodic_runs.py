"""Periodic runs of words, found on a grammar of the text.

The word ids of the texts of a batch are compressed by Re-Pair: pairs that occur again become symbols, frequent
ones first. A round replaces every group of equal pairs that is more frequent than both its neighbours, so that a round is
a few array operations. What is left of a text, all pairs of it different, is joined in a balanced way. Symbols are shared by
all texts of the batch.

A run lies across the boundary between the two halves of exactly one lowest symbol of its text. Runs across a symbol's
boundary are computed once for each symbol, on one of the places where it stands, by the two-sided search for squares at a boundary:
a run of four periods or more has two of them on one side, so the side is a square there and its prefix function (Z) tells the period.
A symbol none of whose three-word windows at the boundary comes again within a quarter of its length has none and is passed by. Runs go from a
symbol to all places where it stands in the derivations; what overlaps by a period with equal period is merged into maximal runs.

A batch holds about a megabyte of text, a longer text is a batch of its own; time grows with
words times the depth of the grammar. Results do not depend on how texts are batched.

Defined results: a null, empty or blank text has no word, no run and an empty rest; rows that repeat are rows of their
own; an empty table gives no rows. Columns beside the two named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import WORD, pick
from tidewatch.llm.textops import chunks, flat, word_bounds, words_of

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Rounds of pairing; what a text of unusual make has left then is joined in a balanced way.
MOST_ROUNDS = 64


class Grammar:
    """Symbols of two halves each: ``start`` (of one place where it stands), ``middle``, ``end``; and all places of each."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray):
        """ids: the words of all texts; owner: the text of each, in order."""
        self.starts, self.middles, self.ends = [], [], []
        self.places, self.symbols = [], []
        self.count = int(ids.max(initial=-1)) + 1
        self.terminals = self.count
        sequence, at, length = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
        state = (sequence, at, length, owner)
        for _ in range(MOST_ROUNDS):
            chosen = self._repeated(state[0], state[3])
            if not len(chosen):
                break
            state = self._join(state, chosen, shared=True)
        while len(state[0]) > 1:
            owner = state[3]
            first = np.r_[True, owner[1:] != owner[:-1]]
            place = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            chosen = np.flatnonzero((place[:-1] % 2 == 0) & ~first[1:])
            if not len(chosen):
                break
            state = self._join(state, chosen, shared=False)

    @staticmethod
    def _repeated(sequence: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Places of pairs that occur again and are more frequent than the pairs on either side; every second one of a stretch of equal ones."""
        if len(sequence) < 2:
            return np.zeros(0, np.int64)
        key = sequence[:-1] * (int(sequence.max()) + 1) + sequence[1:]
        key[owner[:-1] != owner[1:]] = -1
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        # Equal counts go by a scattered order, lest neighbours in the alphabet form long chains.
        rank[np.lexsort(((np.arange(len(counts)) * 0x9E3779B1) & 0xFFFFFFFF, counts))] = np.arange(len(counts))
        rank[counts < 2] = -1
        weight = rank[inverse]
        weight[key < 0] = -1
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        strength = weight[heads]
        best = (strength >= 0) & (strength > np.r_[-2, strength[:-1]]) & (strength > np.r_[strength[1:], -2])
        offset = np.arange(len(key)) - heads[group]
        return np.flatnonzero(best[group] & (offset % 2 == 0))

    def _join(self, state: tuple, chosen: np.ndarray, shared: bool) -> tuple:
        sequence, at, length, owner = state
        whole = length[chosen] + length[chosen + 1]
        if shared:
            key = sequence[chosen] * self.count + sequence[chosen + 1]
            _, where, number = np.unique(key, return_index=True, return_inverse=True)
        else:
            where = number = np.arange(len(chosen))
        one = chosen[where]
        self.starts.append(at[one])
        self.middles.append(at[one] + length[one])
        self.ends.append(at[one] + whole[where])
        self.places.append(at[chosen])
        self.symbols.append(number + self.count - self.terminals)
        stay = np.ones(len(sequence), bool)
        stay[chosen + 1] = False
        sequence, length = sequence.copy(), length.copy()
        sequence[chosen], length[chosen] = number + self.count, whole
        self.count += len(where)
        return sequence[stay], at[stay], length[stay], owner[stay]

    def tables(self) -> tuple[np.ndarray, ...]:
        """start, middle and end of each symbol; the symbols of all places and the places, in order of symbols."""
        parts = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.starts, self.middles, self.ends, self.symbols, self.places)]
        order = np.argsort(parts[3], kind="stable")
        return *parts[:3], parts[3][order], parts[4][order]


def _next_distance(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the distance to the next and to the last place of its text where the same three words begin."""
    n = len(ids)
    far = np.full(n, n + 1, np.int64)
    if n < 4:
        return far, far.copy()
    pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1].astype(np.int64)
    gram = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    order = np.argsort(gram, kind="stable")
    same = (gram[order][1:] == gram[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (owner[order + 2][1:] == owner[order][:-1])
    gap = np.where(same, np.diff(order), n + 1)
    after, before = far, far.copy()
    after[order[:-1]] = gap
    before[order[1:]] = gap
    return after, before


def _prefixes(word: list[int]) -> list[int]:
    """Z function: for each place the length of the longest prefix of ``word`` that stands there."""
    n = len(word)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return n


def _extent(ids: np.ndarray, start: int, anchor: int, end: int, period: int) -> tuple[int, int]:
    """The stretch around ``anchor``, within start..end, in which words ``period`` apart are equal; anchor + period lies in it."""
    after = _equal_ahead(ids[anchor : end - period], ids[anchor + period : end])
    before = _equal_ahead(ids[start:anchor][::-1], ids[start + period : anchor + period][::-1])
    return anchor - before, anchor + after + period


def _squares(side: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Smallest periods up to ``most`` of squares that ``side`` begins with; send back how far the period holds."""
    z = _prefixes(side.tolist())
    period = 1
    while period <= most and period < len(z):
        if z[period] < period:
            period += 1
            continue
        holds = yield period
        # A square of up to half that length has a multiple of the period.
        period = max(period, holds // 2) + 1


def boundary_runs(ids: np.ndarray, start: int, middle: int, end: int, forward: bool, backward: bool) -> set[tuple[int, int, int]]:
    """Runs (start, end, period) that begin before ``middle`` and end after it, maximal within start..end."""
    found = set()
    most = (end - start) // LEAST_PERIODS
    sides = []
    if forward:
        sides.append((ids[middle : min(end, middle + 2 * most)], 0, lambda a, b: b - middle))
    if backward:
        sides.append((ids[max(start, middle - 2 * most) : middle][::-1], 1, lambda a, b: middle - a))
    for side, back, held in sides:
        search = _squares(side, most)
        period = next(search, None)
        while period is not None:
            a, b = _extent(ids, start, middle - back * period, end, period)
            if a < middle < b and b - a >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.add((a, b, period))
            try:
                period = search.send(held(a, b))
            except StopIteration:
                period = None
    return found


def batch_runs(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of all texts: start, end and smallest period, by start, then period. Places count through all texts."""
    start, middle, end, symbols, places = Grammar(ids, owner).tables()
    after, before = _next_distance(ids, owner)
    most = (end - start) // LEAST_PERIODS
    long = np.flatnonzero(end - start >= LEAST_WORDS)
    forward = after[middle[long] - 1] <= most[long]
    backward = np.where(middle[long] - 2 >= 0, before[middle[long] - 2], len(ids) + 1) <= most[long]
    rows = []
    for s in np.flatnonzero(forward | backward):
        x = long[s]
        for a, b, period in boundary_runs(ids, int(start[x]), int(middle[x]), int(end[x]), bool(forward[s]), bool(backward[s])):
            rows.append((x, a - start[x], b - start[x], period))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    table = np.array(rows, np.int64)
    low, high = np.searchsorted(symbols, table[:, 0]), np.searchsorted(symbols, table[:, 0], "right")
    many = high - low
    which = np.repeat(np.arange(len(table)), many)
    place = places[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which]]
    a, b, period = place + table[which, 1], place + table[which, 2], table[which, 3]
    order = np.lexsort((-b, a, period))
    a, b, period = a[order], b[order], period[order]
    # Ends rise from period to period, so the running maximum starts anew with each.
    level = (np.cumsum(np.r_[False, period[1:] != period[:-1]])) * (len(ids) + 1)
    reach = np.maximum.accumulate(b + level)
    new = np.r_[True, (a + level)[1:] > reach[:-1] - period[1:]]
    heads = np.flatnonzero(new)
    b = (reach - level)[np.r_[heads[1:], len(a)] - 1]
    a, period = a[heads], period[heads]
    order = np.lexsort((period, a))
    return a[order], b[order], period[order]


def _worker(id_type: pa.DataType):
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, starts = flat(batch.column("text"))
            first, end, doc_first = word_bounds(data, starts)
            words = words_of(data, first, end)
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), np.diff(doc_first))
            a, b, period = batch_runs(ids, owner)
            covered = np.zeros(len(ids) + 1, np.int64)
            np.add.at(covered, a + period, 1)
            np.add.at(covered, b, -1)
            kept = np.cumsum(covered[:-1]) == 0
            # Each kept word with a blank after it; the last blank of a text goes.
            sizes = np.where(kept, end - first + 1, 0)
            spread = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            place = np.arange(total) - np.repeat(spread, sizes)
            source = np.repeat(first, sizes) + place
            blank = place == np.repeat(end - first, sizes)
            joined = np.where(blank, 0x20, data[np.minimum(source, max(len(data) - 1, 0))] if len(data) else 0).astype(np.uint8)
            bounds = np.r_[spread, total][doc_first]
            rest = [joined[x : max(x, y - 1)].tobytes().decode() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            run_owner = owner[a] if len(a) else np.zeros(0, np.int64)
            offsets = np.searchsorted(run_owner, np.arange(len(batch) + 1))
            runs = pa.StructArray.from_arrays(
                [pa.array(a - doc_first[run_owner]), pa.array(b - a), pa.array(period)], fields=[pa.field(*f) for f in fields]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(id_type),
                    pa.array(np.diff(doc_first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                    pa.array(rest, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return work


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, runs (structs start, length, period, in words, by start and period), collapsed.

    ``collapsed`` has the words that no run contains after its first period, joined by one blank each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = pick(docs, doc_id=id_column, text=text_column)
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_worker(to_arrow_type(kind)), schema)


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one document in ten repeats some of its words to the end, as the hash of its id says."""
    hashed = pick(docs, doc_id="doc_id", text="text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    split = hashed.withColumn("words", words).withColumn("g", F.floor(F.col("h") / 10))
    n = F.size("words")
    a = F.pmod(F.col("g"), n.cast("long")).cast("int")
    period = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil((n - a) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, period), times)), 1, n - a)
    text = F.when(n > 0, F.array_join(F.concat(F.slice("words", 1, a), tail), " ")).otherwise(F.col("text"))
    return split.select("doc_id", text.alias("text"))


def _strongest(runs: Column) -> Column:
    """The run with the most periods; of equal ones the first by start, then period, which is their order."""

    def better(best, run):
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def run_report(docs: DataFrame) -> DataFrame:
    """Per document, with its repeated words: n_runs, the strongest run and digests of all runs and of the rest."""
    found = periodic_runs(repeated(docs)).withColumn("best", _strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
