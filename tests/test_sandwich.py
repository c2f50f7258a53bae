import itertools
import random
from collections import Counter
from decimal import Decimal

import pytest

from tests.conftest import POOL, T0, address, swap, tx
from tidewatch.operators.profiling import sandwich_summary
from tidewatch.operators import sandwich
from tidewatch.operators.sandwich import (
    SandwichSettings,
    attacks_by_attacker,
    reversal_pairs,
    sandwich_attacks,
    sandwich_candidates,
)
from tidewatch.operators.skew import TILE, grid_of, place_everywhere, place_left, place_right, tile_grid
from tidewatch.schemas import SANDWICH_SCHEMA

A, V, W = 1, 2, 3
CLASSIC = [
    swap(1, A, 0, -1000, "1.0", 1000),
    swap(2, V, 1, 5000, "-5.0", 5000),
    swap(3, A, 2, 1100, "-1.1", 1100),
]


def found(table, rows, **settings):
    return sandwich_candidates(table(rows), SandwichSettings(**settings)).collect()


def test_classic(table):
    (row,) = found(table, CLASSIC)
    assert row["attacker"] == address(A)
    assert (row["front_run_tx"], row["victim_tx"], row["back_run_tx"]) == (tx(1), tx(2), tx(3))
    assert row["profit_estimate_usd"] == pytest.approx(100)
    assert row["confidence_score"] == 0.8973
    assert (row["front_run_timestamp"], row["back_run_timestamp"]) == (T0, T0 + 2)


@pytest.mark.parametrize(
    "rows, settings",
    [
        ([swap(1, A, 0, -1000, 1), swap(2, V, 1, 2000, -2), swap(3, W, 2, -500, 1)], {}),
        ([swap(1, A, 0, -1000, 1), swap(2, A, 1, 5000, -5), swap(3, A, 2, 1100, -1)], {}),
        ([swap(1, A, 0, -1000, 1), swap(2, V, 1, -500, 1), swap(3, A, 2, -200, 1)], {}),
        (CLASSIC, {"window_seconds": 1}),
        (CLASSIC[:2], {}),
        (
            [swap(1, A, 0, -100, 1, 100), swap(2, V, 1, 5000, -5, 5000), swap(3, A, 2, 1000, -1, 1000)],
            {"similarity": 0.8},
        ),
        ([swap(1, A, 0, -10, 1, 10), swap(2, V, 1, 50, -5, 50), swap(3, A, 2, 11, -1, 11)], {}),
        ([swap(1, A, 0, 0, 1), swap(2, V, 1, 1, -1), swap(3, A, 2, 5, -1)], {}),
        ([{**row, "amount_usd": "NaN"} if row is CLASSIC[0] else row for row in CLASSIC], {}),
    ],
)
def test_nothing_found(table, rows, settings):
    assert found(table, rows, **settings) == []


def test_two_sandwiches_share_legs(table):
    rows = [
        swap(1, A, -3, -1000, 1, 1000), swap(2, V, -2, 5000, -5, 5000), swap(3, A, -1, 1100, -1, 1100),
        swap(4, A, 2, -800, 1, 800), swap(5, W, 3, 4000, -4, 4000), swap(6, A, 4, 900, -1, 900),
    ]
    pairs = {(r["front_run_tx"], r["victim_tx"], r["back_run_tx"]) for r in found(table, rows, window_seconds=10)}
    one, two, three, four, five, six = (tx(n) for n in range(1, 7))
    assert pairs == {(one, two, three), (one, two, six), (one, five, six), (four, five, six)}


def test_window_is_inclusive_and_zero_works(table):
    assert len(found(table, CLASSIC, window_seconds=2)) == 1
    same_second = [{**row, "timestamp": str(T0)} for row in CLASSIC]
    assert len(found(table, same_second, window_seconds=0)) == 1


def test_victim_without_sender_counts(table):
    rows = [CLASSIC[0], {**CLASSIC[1], "sender": None}, CLASSIC[2]]
    assert len(found(table, rows)) == 1
    nobody = [{**CLASSIC[0], "sender": None}, CLASSIC[1], {**CLASSIC[2], "sender": None}]
    assert found(table, nobody) == []


def test_other_pool_does_not_interfere(table):
    other = "0x" + "b" * 40
    apart = [{**row, "pool": other} if row is CLASSIC[1] else row for row in CLASSIC]
    assert found(table, apart) == []
    both = CLASSIC + [{**row, "pool": other, "tx_hash": tx(100 + i)} for i, row in enumerate(CLASSIC)]
    assert len(found(table, both)) == 2


def test_missing_column_raises(table):
    with pytest.raises(ValueError, match="amount_usd"):
        sandwich_candidates(table(CLASSIC).drop("amount_usd"))


def test_schema_of_an_empty_result(table):
    empty = sandwich_candidates(table([]))
    assert empty.schema.simpleString() == SANDWICH_SCHEMA.simpleString()
    assert empty.count() == 0


@pytest.mark.parametrize(
    "rows, minimum, status",
    [
        ([], 100.0, "Empty DataFrame provided"),
        (CLASSIC, 1e9, "No transactions above minimum USD threshold"),
        (CLASSIC, 100.0, None),
    ],
)
def test_summary_status(table, rows, minimum, status):
    swaps = table(rows)
    settings = SandwichSettings(min_usd=minimum)
    run = sandwich_summary(sandwich_candidates(swaps, settings), swaps, 60, minimum).first()
    assert run["status"] == status
    assert run["total_swaps_analyzed"] == len(rows)
    assert run["total_candidates"] == (1 if status is None else 0)


def _random_swaps(seed, n=120, pools=2, senders=5, span=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sign = rng.choice([-1, 1])
        usd = rng.choice([50, 120, 200, 260, 1000, 1900])
        sender = rng.choice([None, *range(1, senders)])
        rows.append(
            swap(
                i, sender, rng.randrange(span), sign * usd, -sign * rng.choice([0, 1, 1, 1]), usd,
                pool=f"0x{rng.randrange(pools):040x}",
            )
        )
        if sender is None:
            rows[-1]["sender"] = None
    return rows


def _brute_force(rows, window, minimum, similarity):
    """All ordered triples, straight from the definition."""
    result = set()
    kept = [r for r in rows if float(r["amount_usd"]) >= minimum]
    kept.sort(key=lambda r: (int(r["timestamp"]), int(r["block_number"])))

    def side(row):
        a0, a1 = float(row["amount0"]), float(row["amount1"])
        return -1 if a0 < 0 < a1 else 1 if a0 > 0 > a1 else 0

    for front, victim, back in itertools.combinations(kept, 3):
        if len({front["pool"], victim["pool"], back["pool"]}) > 1:
            continue
        if front["sender"] is None or front["sender"] != back["sender"] or victim["sender"] == front["sender"]:
            continue
        if int(back["timestamp"]) - int(front["timestamp"]) > window or side(front) * side(back) != -1:
            continue
        low, high = sorted([float(front["amount_usd"]), float(back["amount_usd"])])
        if low / high >= similarity:
            result.add((front["tx_hash"], victim["tx_hash"], back["tx_hash"]))
    return result


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("pairs_per_task", [None, 9])
def test_equals_brute_force(table, seed, pairs_per_task):
    rows = _random_swaps(seed)
    got = found(table, rows, window_seconds=20, pairs_per_task=pairs_per_task)
    triples = [(r["front_run_tx"], r["victim_tx"], r["back_run_tx"]) for r in got]
    assert len(triples) == len(set(triples))
    assert set(triples) == _brute_force(rows, 20, 100.0, 0.5)
    assert triples


def test_input_order_does_not_matter_and_bounds_are_monotone(table):
    rows = _random_swaps(5)
    key = lambda r: tuple(r)
    base = sorted(found(table, rows, window_seconds=15), key=key)
    assert sorted(found(table, rows[::-1], window_seconds=15), key=key) == base
    wider = set(map(tuple, found(table, rows, window_seconds=25)))
    looser = set(map(tuple, found(table, rows, window_seconds=15, similarity=0.1)))
    assert set(map(tuple, base)) <= wider and set(map(tuple, base)) <= looser


def test_pairs_without_victims(table):
    rows = [CLASSIC[0], CLASSIC[2]]
    (pair,) = reversal_pairs(table(rows)).collect()
    assert pair["similarity"] == pytest.approx(1000 / 1100)
    assert pair["pool"] == POOL


def test_no_cross_join_in_the_plan(table):
    plan = sandwich_candidates(table(CLASSIC))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def _pairs_with_victims(triples):
    return Counter((r["front_run_tx"], r["back_run_tx"]) for r in triples)


@pytest.mark.parametrize("prefix_seconds", [1, 7, 600])
def test_attacks_count_the_triples(table, monkeypatch, prefix_seconds):
    """Buckets of a second and of more than the whole table give the same counts."""
    monkeypatch.setattr(sandwich, "PREFIX_SECONDS", prefix_seconds)
    rows = _random_swaps(1) + _random_swaps(2)
    # Rows that repeat, ties in time, and an order that the block number does not decide.
    rows = [{**row, "tx_hash": tx(i)} for i, row in enumerate(rows)] + [{**row, "tx_hash": tx(i)} for i, row in enumerate(rows[:15])]
    triples = found(table, rows, window_seconds=20)
    attacks = sandwich_attacks(table(rows), SandwichSettings(window_seconds=20))
    got = Counter()
    for row in attacks.collect():
        got[row["front_run_tx"], row["back_run_tx"]] += row["victims"]
    assert got == _pairs_with_victims(triples)
    volume = sum(Decimal(str(r["victim_amount_usd"])) for r in triples)
    assert sum(r["victim_volume_usd"] for r in attacks.collect()) == volume
    totals = {r["attacker"]: (r["victims"], r["pools"]) for r in attacks_by_attacker(attacks).collect()}
    assert {a: v for a, (v, _) in totals.items()} == Counter(r["attacker"] for r in triples)


def test_attacks_of_a_router_are_pairs(table):
    """4,400 swaps of a router and others in one minute: triples go into hundreds of millions, pairs do not."""
    rows = [swap(i, 1 if i % 2 else 2 + i % 7, i // 80, (-1) ** (i // 2) * 1000, -((-1) ** (i // 2)), 1000) for i in range(4400)]
    attacks = sandwich_attacks(table(rows), SandwichSettings(window_seconds=60))
    result = attacks.selectExpr("count(*) AS pairs", "sum(victims) AS victims").first()
    router = [i for i in range(4400) if i % 2]
    up = {i: sum(1 for j in range(i) if j % 2 == 0) for i in router}
    wanted = [up[b] - up[f] for f, b in itertools.combinations(router, 2) if (f // 2 - b // 2) % 2]
    others = result["pairs"] - sum(1 for n in wanted if n)
    assert others >= 0 and result["victims"] >= sum(wanted)
    of_router = attacks.where(attacks.attacker == address(1)).selectExpr("count(*) AS n", "sum(victims) AS v").first()
    assert (of_router["n"], of_router["v"]) == (sum(1 for n in wanted if n), sum(wanted))


def test_attacks_of_nothing(table):
    assert sandwich_attacks(table([])).count() == 0
    assert sandwich_attacks(table([CLASSIC[0], CLASSIC[2]])).count() == 0
    (row,) = sandwich_attacks(table(CLASSIC)).collect()
    assert (row["victims"], row["victim_volume_usd"], row["profit_estimate_usd"]) == (1, Decimal(5000), 100.0)


def test_tiles_meet_every_pair_once_and_stay_small(spark):
    left = spark.range(3000).selectExpr("id AS l", "IF(id < 2400, 0, id % 50) AS k")
    right = spark.range(500).selectExpr("id AS r", "IF(id < 400, 0, id % 50) AS k")
    wanted = left.join(right, "k").count()
    grid = tile_grid(left, right, ["k"], 10_000)
    joined = place_left(left, grid, ["k"], "l").join(place_right(right, grid, ["k"], "r"), ["k", *TILE])
    assert joined.count() == wanted == joined.select("l", "r").distinct().count()
    tiles = joined.groupBy("k", *TILE).count().agg({"count": "max", "k": "count"}).first()
    # Dealing by hash is even to within a few rows.
    assert tiles["max(count)"] < 2 * 10_000 and tiles["count(k)"] >= 90
    # No side is repeated more often than a square grid asks for.
    assert place_left(left, grid, ["k"], "l").count() <= 3000 * 6
    assert tile_grid(left, right, ["k"], 10**7) is None


def test_hot_pool_is_shared_by_tasks(spark, table):
    rows = [swap(i, i % 3, i // 10, (-1) ** i * 1000, -((-1) ** i), 1000) for i in range(300)]
    plain = found(table, rows, window_seconds=10)
    assert sorted(map(tuple, plain)) == sorted(map(tuple, found(table, rows, window_seconds=10, pairs_per_task=25)))
    assert len(plain) > 1000


def test_the_score_of_a_triple_is_computed_once(table):
    plan = sandwich_candidates(table(CLASSIC))._jdf.queryExecution().optimizedPlan().toString()
    # One for the steps of the score and one for its tie, the others are buckets of time.
    assert plan.count("FLOOR((_score") == 1 and plan.count("FLOOR((_tie") == 1


def test_heavy_keys_are_shuffled_however_few_their_bytes(table):
    rows = [swap(i, i % 3, i, (-1) ** i * 1000, (-1) ** (i + 1)) for i in range(40)]
    for find in (sandwich_candidates, sandwich_attacks, reversal_pairs):
        plan = find(table(rows), SandwichSettings(pairs_per_task=4))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [" in plan


def test_a_pair_takes_one_difference_of_volumes(table):
    plan = sandwich_attacks(table(CLASSIC))._jdf.queryExecution().optimizedPlan().toString()
    pair = next(line for line in plan.splitlines() if "victim_volume_usd" in line)
    assert pair.count("volume_") - pair.count("victim_volume_usd") == 2


def _between_joins(plan):
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if "Join [" in line]
    return lines[at[0] + 1 : at[1]]


def test_pairs_of_a_dense_pool_are_neither_shuffled_nor_stored(table, monkeypatch):
    """300 swaps of three senders in a minute: some 30,000 pairs, which pass from join to join."""
    stored = []
    monkeypatch.setattr(sandwich, "written", lambda df, name, to=sandwich.written: (stored.append(df.count()), to(df, name))[1])
    rows = [swap(i, i % 3, i // 5, (-1) ** i * 1000, -((-1) ** i), 1000) for i in range(300)]
    result = sandwich_candidates(table(rows), SandwichSettings(pairs_per_task=1000))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line or "Sort [" in line for line in _between_joins(plan))
    assert sum(stored) < 2 * len(rows)
    assert len(_brute_force(rows[:60], 60, 100.0, 0.5)) == len(found(table, rows[:60], pairs_per_task=1000))


def test_dense_and_sparse_pools_give_what_a_run_without_tiles_does(table):
    """A router in one pool, hardly a pair in the other, with rows that repeat, null senders and pools, and ties."""
    rows = [swap(i, 1 if i % 3 else None, i // 8, (-1) ** (i // 2) * 1000, -((-1) ** (i // 2)), 1000 + i % 9) for i in range(240)]
    other = "0x" + "c" * 40
    rows += [swap(1000 + i, 10 + i % 110, i // 8, (-1) ** (i // 110) * 700, -((-1) ** (i // 110)), 700, pool=other) for i in range(230)]
    rows += [{**row, "pool": None} for row in rows[:9]] + rows[5:20] + rows[300:310]
    plain = Counter(map(tuple, found(table, rows, window_seconds=20, pairs_per_task=None)))
    assert {t[4] for t in plain} == {POOL, other}
    for pairs_per_task in (20, 2000):
        assert Counter(map(tuple, found(table, rows, window_seconds=20, pairs_per_task=pairs_per_task))) == plain


def test_many_swaps_without_a_pair(table):
    rows = [swap(i, i % 2, i // 5, 1000, -1, 1000) for i in range(60)]
    assert found(table, rows, pairs_per_task=10) == []


def test_copies_for_tiles_are_bounded_however_many_pairs(spark):
    """Tiles of one pair each would repeat every row for all others of its key."""
    left = spark.range(2000).selectExpr("id AS l", "id % 4 AS k")
    right = spark.range(1000).selectExpr("id AS r", "id % 4 AS k")
    grid = tile_grid(left, right, ["k"], 1, 16).cache()
    one, other = place_left(left, grid, ["k"], "l"), place_right(right, grid, ["k"], "r")
    assert one.count() + other.count() <= 4 * 3000
    assert one.join(other, ["k", *TILE]).select("l", "r").distinct().count() == left.join(right, "k").count()
    assert place_everywhere(spark.range(4).withColumnRenamed("id", "k"), grid, ["k"]).count() == grid.selectExpr("sum(rows * columns)").first()[0] <= 40
    counts = spark.createDataFrame([(0, 5, 2), (1, 1, 3)], "k long, l long, r long")
    assert [r.k for r in grid_of(counts, ["k"], 4).collect()] == [0]


def test_legs_of_a_heavy_run_are_numbered_once(table):
    rows = [swap(i, i % 3, i, (-1) ** i * 1000, (-1) ** (i + 1)) for i in range(40)]
    result = sandwich_attacks(table(rows), SandwichSettings(pairs_per_task=4))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert "amount0" not in plan and "block_number" not in plan
    settings = SandwichSettings()
    assert -(-settings.window_seconds // settings.heavy_pair_bucket) <= 2


@pytest.mark.parametrize("pairs_per_task", [9, 300])
def test_a_heavy_run_counts_victims_as_a_light_one(table, pairs_per_task):
    """Rows that repeat, ties in time and null senders; a position stands for the whole order."""
    rows = _random_swaps(1, span=30) + _random_swaps(2, span=30)
    rows += [{**row, "tx_hash": tx(500 + i)} for i, row in enumerate(rows[:40])] + rows[30:60] + [{**row, "tx_hash": None} for row in rows[:20]]
    for find in (sandwich_attacks, reversal_pairs):
        light, heavy = (find(table(rows), SandwichSettings(20, pairs_per_task=n)).collect() for n in (None, pairs_per_task))
        assert len(light) > 200 and Counter(map(tuple, light)) == Counter(map(tuple, heavy))
