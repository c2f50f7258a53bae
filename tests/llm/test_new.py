"""Source mixing, conversation repair and periodic runs against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute
from tidewatch.llm import mixing, periodic_runs, repair
from tidewatch.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, conv string, at long, n string, rows string"


def rows_of(df, *columns):
    return brute.ordered([tuple(r) for r in df.select(*columns).collect()])


# Mixing


def test_mix(spark, documents, odd_rows, monkeypatch):
    rows = [(i, t, ["a", "b", None, "é", "c"][k % 5]) for k, (i, t) in enumerate(odd_rows)]
    rows += [(500 + k, "one two three " * 40, "hot") for k in range(60)] + [(900, "same row", "hot")] * 7 + [(901, "", "nothing"), (902, None, "nothing")]
    columns = ("doc_id", "size", "source_size", "target", "taken", "source")
    wanted = brute.target_mix(rows)
    # Small buckets and groups of slots: the steps of ranks and sums have several parts.
    for documents_a_bucket, slots in ((20_000, 1 << 16), (3, 16)):
        monkeypatch.setattr(mixing, "DOCUMENTS_PER_BUCKET", documents_a_bucket)
        monkeypatch.setattr(mixing, "SLOTS_PER_GROUP", slots)
        found = rows_of(mixing.Mix(documents(rows)).taken(), *columns)
        assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in brute.ordered(wanted)]
        assert [r[3] for r in found] == pytest.approx([r[3] for r in brute.ordered(wanted)])
    assert all(r[4] <= 2 * r[1] for r in wanted)


def test_mix_is_whole_blocks_in_low_discrepancy(spark):
    mix = mixing.Mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    targets = {r.number: r for r in mix.targets.collect()}
    slots = sorted((r.slot, r.number, r.rank) for r in mix.slots.collect())
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    seen, whole = Counter(), sum(t.target for t in targets.values())
    for k, (_, number, rank) in enumerate(slots):
        assert rank == seen[number]
        seen[number] += 1
        # After any number of slots each source is within a few slots of its share.
        assert abs(seen[number] - (k + 1) * targets[number].target / whole) < 4
    words, covered = Counter(), defaultdict(list)
    for r in mix.sequence().collect():
        words[r.slot] += r.words
        covered[r.doc_id, r.epoch].append((r["first"], r["words"]))
    short = [s for s, n in words.items() if n != mix.block_tokens]
    assert len(short) <= len(targets)
    for spans in covered.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_mix_of_nothing(spark, documents):
    assert mixing.Mix(documents([(1, "x")]).limit(0)).taken().count() == 0
    only = mixing.Mix(documents([(1, None), (2, "")])).taken().collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in only) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = mixing.Mix(documents([(1, "a b c")])).taken().first()
    assert (one.target, one.taken) == (4.5, 6)


def test_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([(1, "a", 10, 1), (2, "b", 1000, 1), (3, "c", 20, 1), (4, "d", 3000, 1)], "doc_id long, source string, size long, n long")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # 6045 words; a and c stop at 20 and 40, b at 2000, and d gets the rest.
    assert found == {"a": 20.0, "c": 40.0, "b": 1496.25, "d": 4488.75}


# Repair


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            text = rng.choice(["yes.", "No!", "well", "ok ", "", " \t", "what? ", "ü.\n", f"t{rng.randrange(5)}."])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", ""]), text))
    return rows


def test_repair(spark, monkeypatch):
    rng = random.Random(4)
    rows = conversations(rng, 120)
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", None), (500, None, None, None), (501, 3, "user", "same.")]
    rows += [(600, t, rng.choice(["user", "assistant"]), f"x{rng.randrange(60)}.") for t in range(300)]
    rows += [(601, 7, "user", "again.")] * 40 + [(602, 1, "assistant", "long " * 30000 + ".")]
    # An id whose only row is dropped.
    gone = next(c for c in range(1000, 2000) if not brute.damaged_turns([(c, 0, "user", "a.")])[c])
    rows.append((gone, 0, "user", "a."))
    table = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], TURNS)
    wanted = brute.ordered([(c, *brute.repair(v)) for c, v in brute.damaged_turns(rows).items()])
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    # With chunks of four rows most conversations are cut.
    for size in (1 << 12, 4):
        monkeypatch.setattr(repair, "CHUNK_ROWS", size)
        assert rows_of(repair.repair_report(repair.damaged(table), table), *names) == wanted


def test_repair_on_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001")
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert rows_of(found, *names) == brute.ordered([(c, *brute.repair(v)) for c, v in brute.damaged_turns(rows).items()])


def test_crossings_give_the_least_letters():
    rng = random.Random(9)
    roles = ["s", "u", "a", "x"]
    for _ in range(300):
        plan = [(rng.randrange(4), rng.randrange(3)) for _ in range(rng.randint(1, 12))]
        codes = [i * 3 + k for i, k in plan]
        rows = repair.Rows(codes)
        end, cost = repair.last_state(rows.forward(0, len(codes), repair.only(repair.NOTHING)))
        states = repair.crossings(rows, repair.NOTHING, end)
        letters = "".join(repair.MOVES[c][a, b][1] for c, a, b in zip(codes, states, states[1:], strict=False)) + repair._FINISH[end]
        texts = [(k, roles[i], ["%d.", "%d", " "][kind] % k if kind < 2 else " ") for k, (i, kind) in enumerate(plan)]
        assert (cost, letters) == brute.repair(texts)[5:7]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_report(repair.damaged(empty), empty).count() == 0
    only = spark.createDataFrame([(5, 1, "user", "a.", "", 0, "", "")], TURNS)
    found = repair.repair_report(empty, only).first()
    assert tuple(found)[:8] == (5, 0, 0, 0, 0, 0, 0, "")


# Periodic runs


def test_runs_of_many_strings():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 8)):
            letters, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.choice([0, 1, 5, 6, 7, 12, 40, 90])
            word = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                period, a = rng.randint(1, max(1, n // 4)), rng.randrange(n)
                word = [x if i < a else word[a + (i - a) % period] for i, x in enumerate(word)] + [rng.randrange(letters) for _ in range(rng.randint(0, 8))]
            texts.append(word)
        ids = np.array([x for w in texts for x in w], np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        a, b, period = periodic_runs.batch_runs(ids, owner)
        starts = np.cumsum([0] + [len(w) for w in texts])
        wanted = [(s + starts[k], s + n + starts[k], q) for k, w in enumerate(texts) for s, n, q in brute.runs_of(w)]
        assert list(zip(a, b, period, strict=True)) == wanted


def test_run_report(spark, documents, odd_rows):
    rng = random.Random(3)
    rows = [r for r in odd_rows if r[0] != 70]
    for i in range(200, 260):
        words = [f"w{rng.randrange(rng.choice([2, 4, 300]))}" for _ in range(rng.randint(0, 120))]
        rows.append((i, "\n ".join(words)))
    rows += [(300, "a b " * 30), (300, "a b " * 30), (301, "a " * 5), (302, "a " * 6), (303, " ".join("abc" * 4) + " d " + " ".join("abc" * 4)), (304, "x" * 50000 + " y")]
    wanted = brute.ordered([brute.run_row(i, brute.planted_words(i, t)) for i, t in rows])
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert rows_of(periodic_runs.run_report(documents(rows)), *names) == wanted
    assert periodic_runs.run_report(documents(rows).limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(documents([(1, " a\tb a b a b a b c"), (2, None)])).collect()}
    assert [tuple(r) for r in plain[1].runs] == [(0, 8, 2)] and plain[1].collapsed == "a b c"
    assert plain[2].runs == [] and plain[2].collapsed == "" and plain[2].n_words == 0


def test_runs_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert rows_of(periodic_runs.run_report(table), *names) == brute.ordered([brute.run_row(i, brute.planted_words(i, t)) for i, t in rows])
