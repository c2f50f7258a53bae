"""Closed loops and coordinated groups against plain walks; medians per group and percentiles of all ranks."""

import random
import statistics
from decimal import Decimal

import pytest

from tests.conftest import POOL, T0, address, swap, tx
from tidewatch.operators.collusion import GroupSettings, LoopSettings, closed_loops, coordinated_groups, loop_patterns
from tidewatch.operators.components import connected_components
from tidewatch.operators.profiling import distinct_counts, run_counters, swap_set_stats
from tidewatch.operators.quality import ERRORS, with_pattern_errors
from tidewatch.operators.quantiles import exact_percentiles, group_medians, robust_z


def paid(n, sender, recipient, seconds, usd=1000, **other):
    return swap(n, sender, seconds, -1000, 1, usd, recipient=address(recipient), **other)


def loops_by_walk(rows, window, minimum, similarity, most):
    kept = [r for r in rows if Decimal(r["amount_usd"]) >= minimum and r["sender"] != r["recipient"]]
    kept.sort(key=lambda r: (int(r["timestamp"]), int(r["block_number"])))
    found = []

    def walk(path):
        first, last = path[0], path[-1]
        for row in kept[kept.index(last) + 1 :]:
            if row["pool"] != first["pool"] or row["sender"] != last["recipient"] or int(row["timestamp"]) - int(first["timestamp"]) > window:
                continue
            usd = [float(r["amount_usd"]) for r in [*path, row]]
            if min(usd) / max(usd) < similarity:
                continue
            if row["recipient"] == first["sender"]:
                found.append(tuple(r["tx_hash"] for r in [*path, row]))
            elif len(path) + 1 < most and row["recipient"] not in [r["sender"] for r in [*path, row]]:
                walk([*path, row])

    for row in kept:
        walk([row])
    return sorted(found)


@pytest.mark.parametrize("pairs_per_task", [None, 4, 10**8])
def test_loops_equal_a_walk(table, pairs_per_task):
    rng = random.Random(3)
    rows = [paid(i, rng.randrange(5), rng.randrange(5), rng.randrange(120), rng.choice([900, 1000, 1100, 1300]), pool=address(rng.randrange(2))) for i in range(160)]
    settings = LoopSettings(40, Decimal("950"), 0.85, 4, pairs_per_task)
    found = sorted(tuple(r["txs"]) for r in closed_loops(table(rows), settings).collect())
    assert found == loops_by_walk(rows, 40, 950, 0.85, 4) and len(found) > 20
    assert {len(txs) for txs in found} == {2, 3, 4}


def test_each_hop_is_joined_once(table):
    rows = [paid(1, 1, 2, 0), paid(2, 2, 3, 5), paid(3, 3, 1, 9)]
    plan = closed_loops(table(rows), LoopSettings(min_usd=Decimal(500), pairs_per_task=1))._jdf.queryExecution().optimizedPlan().toString()
    # The last hop, and the heavy keys of its two sides; earlier hops are read.
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftOuter") <= 2


def test_loop_records(table):
    rows = [paid(1, 1, 2, 0), paid(2, 2, 3, 5, 990), paid(3, 3, 1, 9, 980), paid(4, 1, 1, 10), paid(5, 3, 1, 10, 20)]
    some = LoopSettings(min_usd=Decimal(500))
    (record,) = loop_patterns(table(rows), some).collect()
    assert record["involved_addresses"] == [address(1), address(2), address(3)] and record["related_tx_hashes"] == [tx(1), tx(2), tx(3)]
    assert record["metrics"]["volume_usd_total"] == "2970.000000000000000000" and record["metrics"]["time_window_seconds"] == 9
    assert with_pattern_errors(loop_patterns(table(rows), some)).first()[ERRORS] == []
    assert loop_patterns(table(rows[:2])).count() == 0 and loop_patterns(table([])).count() == 0
    # The recipient comes back too late, or the loop is too long.
    assert closed_loops(table(rows), LoopSettings(8, Decimal(500))).count() == 0 and closed_loops(table(rows), LoopSettings(min_usd=Decimal(500), most_swaps=2)).count() == 0


def test_groups(table):
    rows = []
    for minute in range(4):
        rows += [swap(100 * minute + k, k, 60 * minute - T0 % 60 + k, -1000, 1, 1000 + k) for k in (1, 2, 3)]
        rows += [swap(100 * minute + 50 + k, 7 + k, 60 * minute - T0 % 60 + k, 1000, -1, 5000) for k in (0, 1)]
    # One meeting only; another size of amounts; a router that trades many times a minute.
    rows += [swap(900, 20, -T0 % 60 + 3000, -1000, 1, 1000), swap(901, 21, -T0 % 60 + 3001, -1000, 1, 1000), swap(902, 1, 30, -1000, 1, 900000)]
    rows += [swap(1000 + i, 3, 60 * (i % 4) - T0 % 60 + 9, -1000, 1, 1001) for i in range(40)]
    found = sorted((r["address"], r["group_id"], r["group_size"], r["meetings"]) for r in coordinated_groups(table(rows)).collect())
    assert found == [(address(k), address(1), 3, 8) for k in (1, 2, 3)] + [(address(k), address(7), 2, 4) for k in (7, 8)]
    assert coordinated_groups(table(rows), GroupSettings(min_meetings=5)).count() == 0
    assert coordinated_groups(table([])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(500, 400 + i) for i in range(50)]
    edges += [(7, 7), (900, 900)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    wanted = {(n, c) for n, c in label.items() if n != 900}
    found = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert {tuple(r) for r in found.collect()} == wanted


def test_group_medians_and_scores(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, 5.0, rng.random() * 100])) for _ in range(900)] + [("one", 3.0), ("none", None), ("same", 1.0), ("same", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    medians = {r["k"]: r["median"] for r in group_medians(df, ["k"], "v").collect()}
    assert medians == pytest.approx({k: statistics.median(v) for k, v in groups.items()})
    for r in robust_z(df, ["k"], "v").collect():
        if r["k"] not in groups or r["v"] is None:
            assert r["robust_z"] is None
            continue
        spread = statistics.median(abs(v - medians[r["k"]]) for v in groups[r["k"]])
        assert r["robust_z"] == (pytest.approx(0.6745 * (r["v"] - medians[r["k"]]) / spread) if spread else None)
    assert group_medians(df.limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("limit", [1, 20, 10**6])
def test_all_ranks_at_once(spark, limit, monkeypatch):
    df = spark.range(2500).selectExpr("pmod(xxhash64(id), 1000000) / 7.3 AS x").unionByName(spark.range(500).selectExpr("CAST(13 AS DOUBLE) AS x"))
    values = sorted(r["x"] for r in df.collect())

    def plain(p):
        at = p * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        return low + (high - low) * (at - int(at))

    ranks = [0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1]
    assert exact_percentiles(df, "x", ranks, limit) == [plain(p) for p in ranks]


def test_passes_do_not_depend_on_the_number_of_ranks(spark):
    df = spark.range(3000).selectExpr("pmod(xxhash64(id), 1000000) / 7.3 AS x")
    tracker = spark.sparkContext.statusTracker()

    def jobs(ranks, group):
        spark.sparkContext.setJobGroup(group, group)
        exact_percentiles(df, "x", ranks, 20)
        spark.sparkContext._jsc.clearJobGroup()
        return len(tracker.getJobIdsForGroup(group))

    # One rank at a time would take nineteen times as many. Where brackets end by chance makes a pass more or less.
    assert abs(jobs([0.5], "one rank") - jobs([0.05 * i for i in range(1, 20)], "many ranks")) <= 3


def test_distinct_counts_copy_no_rows(table, spark):
    rows = [swap(i, i % 7, i, -1, 1, recipient=address(i % 3) if i % 4 else None, pool=address(i % 2)) for i in range(40)]
    stats = swap_set_stats(table(rows))
    row = stats.first()
    assert (row["total_count"], row["unique_pools"], row["unique_senders"], row["unique_recipients"]) == (40, 2, 7, 3)
    assert (row["first_timestamp"], row["last_timestamp"]) == (str(T0), str(T0 + 39))
    assert stats.columns[:4] == ["total_count", "unique_pools", "unique_senders", "unique_recipients"]
    for frame in (stats, run_counters(table(rows))):
        assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()
    nothing = swap_set_stats(table([])).first()
    assert (nothing["total_count"], nothing["unique_pools"], nothing["first_timestamp"]) == (0, 0, None)
    assert distinct_counts(table(rows), ["pool"]).first()["pool"] == 2 and POOL
