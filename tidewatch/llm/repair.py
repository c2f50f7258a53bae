"""Repair of the role structure of conversations at least cost, by divide and conquer.

A conversation is well formed if the first letters of its roles are (s?(ua)+)? : at most one system turn, then user and
assistant in turns. Each row is kept (0), given the role user or assistant (rerole, 2) or deleted (3, the only choice for blank
and duplicate rows), an empty turn may be inserted anywhere (2), and a row that stays truncated costs 1. Of the cheapest
repairs the one whose letters (D, I, K, R in order) come first in ASCII is taken.

Four states say what may follow: nothing yet, after system, after user, after assistant. A row is a table of costs
from state to state, and so is a stretch of rows. To find the repair, the cost vector of the first half of a stretch, from its
start, meets that of the second half, from its end; of the states with the least sum the one is crossed that the
least letters lead to, and both halves are solved in the same way. So memory is linear. Letters are compared by ranks: two ways
through the same rows end with a row's letter, so neither continues the other and the order of ways is settled at the first difference.

Rows are sorted once over the cluster, by conversation, turn, role and text. A conversation may hold a third of
all rows: it is cut into chunks of at most ``CHUNK_ROWS`` rows, the chunks are summed up as tables in parallel, the
crossings between chunks are found from the tables, and the chunks are solved in parallel. Duplicates are found by
the first place of each (conversation, role, text), an aggregate, and joined by place, which is unique. Only the digest of a
conversation's repaired text has to pass all its lines, in order, through one task; it holds one line at a time.

Defined results: rows go by turn, null first, then role, then text; a null role or text counts as one blank, so a null text is a
blank row; equal rows are repeated rows, so all but the first are duplicates; a null conversation is a conversation; an
empty table gives no rows; a conversation listed in ``every`` that has no rows gets zeros and empty texts. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import pick, staged

#: Rows of a chunk at most: a batch of chunks has to fit into a task's memory.
CHUNK_ROWS = 1 << 10
#: Rows of conversations that one task sums up or solves, about 50 microseconds each.
ROWS_PER_TASK = 100_000
#: Chunks or conversations that are Python objects at once.
SLICE = 256
INSERT, RENAME, DELETE, TRUNCATED = 2, 2, 3, 1
#: States are numbered as in the text above.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
FINE, CUT, MUST_GO = range(3)
INITIALS = "sua"
_INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: Cheapest way from each state to a well-formed end.
_FINISH = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Table = tuple  # per state a tuple of four (cost, order) or None
Vector = tuple  # per state (cost, rank) or None


def _row_moves(initial: str, kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to): least cost and, of equal ones, least letters. Two inserted turns lead back, more never help."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in STATES:
        state = begin
        for inserted in range(3):
            ways = [(state, DELETE, "D")]
            if kind != MUST_GO:
                extra = TRUNCATED if kind == CUT else 0
                ways.append((ASSISTANT if state == USER else USER, RENAME + extra, "R"))
                if (initial, state) in _KEPT:
                    ways.append((_KEPT[initial, state], extra, "K"))
            for end, cost, letter in ways:
                way = (cost + INSERT * inserted, "I" * inserted + letter)
                best[begin, end] = min(way, best.get((begin, end), way))
            state = _INSERTED[state]
    return best


def _table(moves: dict[tuple[int, int], tuple[int, str]]) -> Table:
    """Costs, and the order of the letters of the four ways from each state."""
    rows = []
    for begin in STATES:
        letters = sorted(moves[begin, end][1] for end in STATES if (begin, end) in moves)
        rows.append(tuple((moves[begin, end][0], letters.index(moves[begin, end][1])) if (begin, end) in moves else None for end in STATES))
    return tuple(rows)


#: By code: initial (s, u, a, other) times 3 plus kind.
MOVES = [_row_moves(initial, kind) for initial in (*INITIALS, "") for kind in (FINE, CUT, MUST_GO)]
ROW_TABLES = [_table(moves) for moves in MOVES]


def advance(vector: Vector, table: Table) -> Vector:
    """The cost vector after one more row or stretch; ranks order the letters that lead to each state."""
    best = []
    for end in STATES:
        ways = [(vector[b][0] + table[b][end][0], vector[b][1], table[b][end][1]) for b in STATES if vector[b] and table[b][end]]
        best.append(min(ways, default=None))
    order = sorted(x[1:] for x in best if x)
    return tuple(x and (x[0], order.index(x[1:])) for x in best)


def retreat(vector: Vector, table: Table) -> Vector:
    """The cost vector before a row or stretch, from that after it; without ranks."""
    out = []
    for begin in STATES:
        ways = [table[begin][e][0] + vector[e][0] for e in STATES if vector[e] and table[begin][e]]
        out.append((min(ways), 0) if ways else None)
    return tuple(out)


class Rows:
    """A stretch of rows by their codes; steps are looked up, as vectors that differ by a constant step alike."""

    _steps: dict = {}

    def __init__(self, codes):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def _walk(self, vector: Vector, codes, step) -> Vector:
        base, steps = 0, self._steps
        for code in codes:
            found = steps.get((vector, code, step))
            if found is None:
                after = step(vector, ROW_TABLES[code])
                low = min(x[0] for x in after if x)
                found = steps[vector, code, step] = (low, tuple(x and (x[0] - low, x[1]) for x in after))
            base += found[0]
            vector = found[1]
        return tuple(x and (x[0] + base, x[1]) for x in vector)

    def forward(self, low: int, high: int, vector: Vector) -> Vector:
        return self._walk(vector, self.codes[low:high], advance)

    def backward(self, low: int, high: int, vector: Vector) -> Vector:
        return self._walk(vector, self.codes[low:high][::-1], retreat)

    def table(self) -> Table:
        """The whole stretch as one table."""
        return tuple(self.forward(0, len(self), only(s)) for s in STATES)


class Stretches:
    """A sequence of stretches by their tables."""

    def __init__(self, tables: list[Table]):
        self.tables = tables

    def __len__(self) -> int:
        return len(self.tables)

    def forward(self, low: int, high: int, vector: Vector) -> Vector:
        for table in self.tables[low:high]:
            vector = advance(vector, table)
        return vector

    def backward(self, low: int, high: int, vector: Vector) -> Vector:
        for table in self.tables[low:high][::-1]:
            vector = retreat(vector, table)
        return vector


def only(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in STATES)


def last_state(vector: Vector) -> tuple[int, int]:
    """The state to end in and the whole cost, from the vector after the last row."""
    ways = [(x[0] + INSERT * len(_FINISH[s]), x[1], s) for s, x in enumerate(vector) if x]
    cost, _, state = min(ways)
    return state, cost


def crossings(parts: Rows | Stretches, start: int, end: int) -> list[int]:
    """The states before the first, between all and after the last of ``parts``, on the way with the least cost, then letters."""
    states = [start] + [end] * len(parts)
    open_parts = [(0, len(parts))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        before = parts.forward(low, middle, only(states[low]))
        after = parts.backward(middle, high, only(states[high]))
        ways = [(before[s][0] + after[s][0], before[s][1], s) for s in STATES if before[s] and after[s]]
        states[middle] = min(ways)[2]
        open_parts += [(low, middle), (middle, high)]
    return states


# Faults and places of rows.


def _blank(text: Column) -> Column:
    return ~text.rlike("[^\\x20\\x09-\\x0D]")


def _kind(text: Column) -> Column:
    """Fine or truncated: whether the last character that is no blank ends a sentence."""
    return F.when(text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), F.lit(FINE)).otherwise(F.lit(CUT))


def _named(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and ``conv``: a text that tells conversations apart and is never null."""
    one = F.lit(" ")
    named = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    conv = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    return named.select("conv_id", conv.alias("conv"), "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order: ``at`` rises with conversation, turn, role and text; ``n`` rows are equal; ``code`` without duplicates."""
    equal = _named(rows).groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = equal.repartitionByRange(*order).sortWithinPartitions(*order)
    first = F.substring("role", 1, 1)
    initial = F.lit(len(INITIALS))
    for number, letter in enumerate(INITIALS):
        initial = F.when(first == letter, F.lit(number)).otherwise(initial)
    kind = F.when(_blank(F.col("text")), F.lit(MUST_GO)).otherwise(_kind(F.col("text")))
    return staged(
        dealt.select(
            F.monotonically_increasing_id().alias("at"), "conv", "turn", "role", "text", "n", _blank(F.col("text")).alias("blank"),
            (initial * 3 + kind).cast("int").alias("code"),
        ),
        "turns",
    )


def _codes(rows: DataFrame) -> DataFrame:
    """at, conv, turn, n, code, blank, first (of its role and text): what the repair needs, without texts."""
    texts = rows.where("NOT blank").select("conv", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "role", "text").alias("h2"), "at")
    firsts = texts.groupBy("conv", "h1", "h2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = rows.select("at", "conv", "turn", "n", "code", "blank").join(firsts, "at", "left")
    first = F.coalesce("first", F.lit(False))
    code = F.when(F.col("blank") | first, F.col("code")).otherwise(F.floor(F.col("code") / 3) * 3 + MUST_GO).cast("int")
    return staged(marked.select("at", "conv", "turn", "n", code.alias("code"), "blank", first.alias("first")), "turn-codes")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _chunks(codes: DataFrame) -> DataFrame:
    """One row per chunk: conv, chunk and its rows in order."""
    chunk = F.floor(F.col("at") / CHUNK_ROWS).alias("chunk")
    rows = F.sort_array(F.collect_list(F.struct("at", "code", "n")))
    return codes.select("conv", chunk, "at", "code", "n").groupBy("conv", "chunk").agg(rows.alias("rows"))


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, chunk, costs and orders of its table (16 each, -1 where there is no way), extra cost of repeats, illegal, first and last initial."""
    for batch in _slices(batches):
        out = []
        for conv, chunk, rows in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "rows")), strict=True):
            codes = [r["code"] for r in rows]
            repeats = sum(r["n"] for r in rows) - len(rows)
            initials = [c // 3 for c in codes]
            illegal = sum(p not in _LEGAL for p in zip(initials, initials[1:], strict=False)) + repeats
            cells = [x for row in Rows(codes).table() for x in row]
            out.append((conv, chunk, [x[0] if x else -1 for x in cells], [x[1] if x else -1 for x in cells], DELETE * repeats, illegal, initials[0], initials[-1]))
        names = ["conv", "chunk", "costs", "orders", "extra", "illegal", "head", "tail"]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the states at its ends; at the last chunk of a conversation its whole cost and number of illegal neighbours."""
    for batch in _slices(batches):
        out = []
        for conv, parts in zip(batch.column("conv").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            tables = []
            for p in parts:
                cells = [(c, o) if c >= 0 else None for c, o in zip(p["costs"], p["orders"], strict=True)]
                tables.append(tuple(tuple(cells[4 * s : 4 * s + 4]) for s in STATES))
            stretches = Stretches(tables)
            end, cost = last_state(stretches.forward(0, len(tables), only(NOTHING)))
            states = crossings(stretches, NOTHING, end)
            illegal = sum(p["illegal"] for p in parts) + sum((a["tail"], b["head"]) not in _LEGAL for a, b in zip(parts, parts[1:], strict=False))
            cost += sum(p["extra"] for p in parts)
            for i, p in enumerate(parts):
                last = i == len(parts) - 1
                out.append((conv, p["chunk"], states[i], states[i + 1], last, cost if last else None, illegal if last else None))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "chunk", "begin", "end", "last", "cost", "illegal"]
        )


def _lines(state: int, letters: str) -> tuple[list[str], str | None, bool]:
    """Roles of inserted turns before a row, the new role of the row if it gets one, and whether it stays."""
    roles = []
    for letter in letters[:-1]:
        assert letter == "I"
        state = _INSERTED[state]
        roles.append(_NAMES[state])
    renamed = _NAMES[ASSISTANT if state == USER else USER] if letters[-1] == "R" else None
    return roles, renamed, letters[-1] != "D"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk its letters and the rows that leave lines: at, roles inserted before, new role, whether it stays, roles inserted after."""
    line = pa.struct([("at", pa.int64()), ("before", pa.list_(pa.string())), ("renamed", pa.string()), ("stays", pa.bool_()), ("after", pa.list_(pa.string()))])
    for batch in _slices(batches):
        out = []
        names = ("conv", "chunk", "rows", "begin", "end", "last")
        for conv, chunk, rows, begin, end, last in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            codes = [r["code"] for r in rows]
            states = crossings(Rows(codes), begin, end)
            letters, lines = [], []
            for i, r in enumerate(rows):
                way = MOVES[codes[i]][states[i], states[i + 1]][1]
                letters.append(way + "D" * (r["n"] - 1))
                before, renamed, stays = _lines(states[i], way)
                after = []
                if last and i == len(rows) - 1 and _FINISH[end]:
                    letters.append(_FINISH[end])
                    after = [_NAMES[USER], _NAMES[ASSISTANT]][-len(_FINISH[end]) :]
                if before or stays or after:
                    lines.append({"at": r["at"], "before": before, "renamed": renamed, "stays": stays, "after": after})
            out.append((conv, chunk, "".join(letters), lines))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(line)]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "chunk", "letters", "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv and the digest of its lines; the rows come sorted, one line is held at a time."""
    conv, digest = None, None

    def rows(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["conv", "repaired_sha256"])

    for batch in batches:
        done = []
        for key, line in zip(batch.column("conv").to_pylist(), batch.column("line"), strict=True):
            if key != conv:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_buffer())
        yield rows(done)
    if digest:
        yield rows([(conv, digest.hexdigest())])


class Repair:
    """The cheapest repair of all conversations of ``rows`` (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame):
        self.rows = placed(rows)
        self.codes = _codes(self.rows)
        # Chunks are small in bytes and slow: they are dealt out by the number of their rows.
        tasks = max(1, -(-self.codes.count() // ROWS_PER_TASK))
        chunks = staged(_chunks(self.codes), "turn-chunks").repartition(tasks, "conv", "chunk")
        tables = "conv string, chunk long, costs array<long>, orders array<int>, extra long, illegal long, head int, tail int"
        parts = F.sort_array(F.collect_list(F.struct("chunk", "costs", "orders", "extra", "illegal", "head", "tail")))
        joined = chunks.mapInArrow(_summaries, tables).groupBy("conv").agg(parts.alias("parts"))
        borders = "conv string, chunk long, begin int, end int, last boolean, cost long, illegal long"
        self.borders = staged(joined.mapInArrow(_borders, borders), "turn-borders")
        ready = chunks.hint("merge").join(self.borders, ["conv", "chunk"]).select("conv", "chunk", "rows", "begin", "end", "last")
        lines = "array<struct<at: long, before: array<string>, renamed: string, stays: boolean, after: array<string>>>"
        self.solved = staged(ready.mapInArrow(_solved, f"conv string, chunk long, letters string, lines {lines}"), "turn-edits")

    def turns(self) -> DataFrame:
        """The repaired turns: conv, at, part (0 inserted before row ``at``, 1 the row, 2 inserted after), place, role, text."""
        edits = self.solved.select(F.explode("lines").alias("e")).select("e.*")
        rows = self.rows.select("at", "conv", "role", "text").hint("merge").join(edits, "at")

        def inserted(column: str, part: int) -> Column:
            return F.transform(column, lambda r, i: F.struct(F.lit(part).alias("part"), i.alias("place"), r.alias("role"), F.lit("").alias("text")))

        own = F.struct(F.lit(1).alias("part"), F.lit(0).alias("place"), F.coalesce("renamed", "role").alias("role"), F.col("text").alias("text"))
        stays = F.when(F.col("stays"), F.array(own)).otherwise(F.array().cast("array<struct<part: int, place: int, role: string, text: string>>"))
        return rows.select("conv", "at", F.inline(F.concat(inserted("before", 0), stays, inserted("after", 2))))

    def digests(self) -> DataFrame:
        """conv, repaired_sha256: of the lines role:text of each conversation that has any."""
        lines = self.turns().select("conv", "at", "part", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
        dealt = lines.repartition("conv").sortWithinPartitions("conv", "at", "part", "place")
        return dealt.mapInArrow(_digests, "conv string, repaired_sha256 string")

    def faults(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated."""
        counted = [
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"),
            F.sum((F.col("code") % 3 == CUT).cast("long")).alias("truncated"),
        ]
        by_turn = self.codes.groupBy("conv", "turn").agg(*counted)
        span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        return by_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    def audits(self) -> DataFrame:
        """conv, audit: the letters of all chunks."""
        parts = F.sort_array(F.collect_list(F.struct("chunk", "letters")))
        return self.solved.groupBy("conv").agg(F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit"))

    def summary(self, every: DataFrame) -> DataFrame:
        """Per conversation of ``every``: its faults, cost, letters and the digest of its repaired text."""
        whole = self.borders.where("last").select("conv", "cost", "illegal")
        out = _named(every).select("conv_id", "conv").distinct()
        for part in (self.faults(), whole, self.audits(), self.digests()):
            out = out.join(part, "conv", "left")
        numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        empty = F.sha2(F.lit("").cast("binary"), 256)
        return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one row in five damaged, as the hash of conversation and turn says."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    rows = rows.withColumn("role", F.coalesce("role", one)).withColumn("text", F.coalesce("text", one))
    rows = rows.withColumn("fate", (F.crc32(key.cast("binary")) % 20).cast("int")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def repair_report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Per conversation of ``every``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return Repair(rows).summary(every)
