import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import POOL, T0, address, swap, tx
from tidewatch.functions.scoring import wash_confidence
from tidewatch.operators.patterns import flat_patterns, wash_patterns
from tidewatch.operators.profiling import run_counters, wash_pattern_rollup
from tidewatch.operators.quality import ERRORS, with_pattern_errors, with_wash_errors
from tidewatch.operators import wash
from tidewatch.operators.scan import carried_bits
from tidewatch.operators.wash import WashSettings, consecutive_pairs, roundtrips, wash_trades
from tidewatch.schemas import WASH_SCHEMA
from tidewatch.session import written

T = 7


def alternating(times, usd=1000, pool=POOL, first=1, trader=T, **other):
    return [
        swap(first + i, trader, t, -1000 if i % 2 == 0 else 1000, 1 if i % 2 == 0 else -1, usd, pool=pool, **other)
        for i, t in enumerate(times)
    ]


FOUR = alternating(range(0, 240, 30))


def test_four_roundtrips(table):
    (row,) = wash_trades(table(FOUR)).collect()
    assert row["trader"] == address(T) and row["pool"] == POOL
    assert row["roundtrip_count"] == 4
    assert (row["first_tx"], row["last_tx"]) == (tx(1), tx(8))
    assert (row["first_timestamp"], row["last_timestamp"]) == (T0, T0 + 210)
    assert row["total_volume_usd"] == Decimal(8000)
    assert row["avg_roundtrip_time"] == 30.0
    assert row["price_variance"] == 0.0
    assert row["confidence_score"] == 0.8471
    assert row["time_span_seconds"] == 210


@pytest.mark.parametrize(
    "rows",
    [
        alternating([0, 60, 420, 480, 840, 900]),
        alternating(range(0, 240, 30), usd=100),
        alternating(range(0, 120, 30), pool="0x" + "1" * 40)
        + alternating(range(0, 120, 30), pool="0x" + "2" * 40, first=50),
        alternating(range(0, 150, 30)),
    ],
)
def test_nothing_found(table, rows):
    assert wash_trades(table(rows)).collect() == []


def test_counters_of_two_pools(table):
    rows = alternating(range(0, 120, 30), pool="0x" + "1" * 40)
    rows += alternating(range(0, 120, 30), pool="0x" + "2" * 40, first=50)
    counters = run_counters(table(rows)).first()
    assert (counters["total_swaps_analyzed"], counters["pools_analyzed"]) == (8, 2)


def test_interleaved_trader(table):
    rows = alternating([0, 30, 60, 90, 180, 210, 240, 270])
    rows += [swap(90, 8, 120, -1000, 1), swap(91, 8, 150, 1000, -1)]
    (row,) = wash_trades(table(rows)).collect()
    assert (row["trader"], row["roundtrip_count"], row["time_span_seconds"]) == (address(T), 4, 270)


def test_prices_then_ratios_then_default(table):
    rows = [dict(row) for row in FOUR]
    for i, row in enumerate(rows):
        row["sqrtPriceX96"] = None
        row["amount0"] = str((-1 if i % 2 == 0 else 1) * (1000 if i != 0 else 1100))
    (row,) = wash_trades(table(rows)).collect()
    ratios = [1.1, 1.0, 1.0, 1.0]
    mean = sum(ratios) / 4
    deviation = (sum((r - mean) ** 2 for r in ratios) / 3) ** 0.5
    assert row["price_variance"] == pytest.approx(deviation / mean)
    (row,) = wash_trades(table(rows).drop("sqrtPriceX96")).collect()
    assert row["price_variance"] == pytest.approx(deviation / mean)
    # A zero second leg has no ratio: it counts as a sell, the roundtrip stays.
    for row in rows[1::2]:
        row["amount0"] = "0"
    (row,) = wash_trades(table(rows)).collect()
    assert row["price_variance"] == 0.1


def test_one_roundtrip_has_no_dispersion(table):
    (row,) = wash_trades(table(FOUR[:2]), WashSettings(min_roundtrips=1)).collect()
    assert row["price_variance"] is None
    # count: (1-3)/7+0.5, no credit for steadiness, pace 0.95
    assert row["confidence_score"] == pytest.approx(0.4 * (0.5 - 2 / 7) + 0.2 * 0.95, abs=1e-4)


def test_score_steps(spark):
    score = wash_confidence(F.col("n"), F.col("cv"), F.col("gap"), 300)
    rows = spark.createDataFrame([(10, 0.0, 0.0), (3, 0.1, 300.0), (30, 0.0, 0.0)], "n long, cv double, gap double")
    assert [r[0] for r in rows.select(score).collect()] == [1.0, 0.3, 1.0]


def test_missing_column_raises(table):
    with pytest.raises(ValueError, match="amount0"):
        wash_trades(table(FOUR).drop("amount0"))


def test_schema_of_an_empty_result(table):
    empty = wash_trades(table([]))
    assert empty.schema.simpleString() == WASH_SCHEMA.simpleString()
    assert empty.count() == 0


def _greedy(rows, window, minimum):
    """Roundtrips by walking each trader's swaps."""
    groups = defaultdict(list)
    for row in rows:
        groups[row["pool"], row["sender"]].append(row)
    pairs = set()
    for trades in groups.values():
        trades.sort(key=lambda r: (int(r["timestamp"]), int(r["block_number"])))
        at = 0
        while at < len(trades) - 1:
            one, two = trades[at], trades[at + 1]
            turned = (float(one["amount0"]) < 0) != (float(two["amount0"]) < 0)
            near = int(two["timestamp"]) - int(one["timestamp"]) <= window
            large = min(Decimal(one["amount_usd"]), Decimal(two["amount_usd"])) >= minimum
            if turned and near and large:
                pairs.add((one["tx_hash"], two["tx_hash"]))
                at += 2
            else:
                at += 1
    return pairs


def _random_trades(seed, n=400, turn=0.85):
    """Mostly alternating trades, so that runs are long and cross many chunks."""
    rng = random.Random(seed)
    rows, sign, time = [], 1, 0
    for i in range(n):
        sign = -sign if rng.random() < turn else sign
        time += rng.choice([0, 1, 2, 3, 5, 9, 12])
        usd = "999" if rng.random() < 0.03 else "1000"
        rows.append(swap(i, rng.choice([1, 1, 1, 2]), time, sign * 10, -sign, usd))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("windows_per_chunk, rows_per_task", [(1, None), (3, 10), (1000, 200), (1000, None)])
def test_roundtrips_equal_the_greedy_walk(table, seed, windows_per_chunk, rows_per_task):
    """A limit of 10 splits both traders' chunks, one of 200 only those of the busier trader."""
    rows = _random_trades(seed)
    settings = WashSettings(10, windows_per_chunk=windows_per_chunk, rows_per_task=rows_per_task)
    got = [(r["open_tx"], r["close_tx"]) for r in roundtrips(table(rows), settings).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _greedy(rows, 10, 1000)


def test_run_without_any_break_over_many_chunks(table):
    rows = alternating(range(0, 303, 3))
    for per_chunk, limit in ((1, None), (2, None), (2, 2)):
        settings = WashSettings(3, windows_per_chunk=per_chunk, rows_per_task=limit)
        assert consecutive_pairs(table(rows), settings).count() == 100
        got = {(r["open_tx"], r["close_tx"]) for r in roundtrips(table(rows), settings).collect()}
        assert got == {(tx(n), tx(n + 1)) for n in range(1, 101, 2)}


def test_windows_are_evaluated_once(spark, table, monkeypatch):
    """The edges are written once; what follows joins them with the carried parities and has no window."""
    plans = []
    monkeypatch.setattr(wash, "written", lambda df, name: plans.append(df) or written(df, name))
    result = wash_trades(table(alternating(range(0, 303, 3))), WashSettings(window_seconds=3, windows_per_chunk=2))
    result.collect()
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and "Window" in text(plans[0])
    assert "Window" not in text(result) and "Python" not in text(result)


@pytest.mark.parametrize("fanout", [2, 3, 64])
def test_carried_bits_equal_a_walk(spark, fanout):
    rng = random.Random(fanout)
    rows, wanted = [], set()
    for key in range(6):
        chunk, bit, reached = 5, 0, None
        for _ in range(rng.randint(0, 40)):
            chunk += rng.choice([1, 1, 1, 2, 7])
            out0, is_open = rng.randrange(2), rng.random() < 0.8
            into = chunk + rng.choice([1, 1, 1, 2])
            arrives = bit if reached == chunk else 0
            rows.append((key, chunk, into, out0, 1 - out0 if is_open else out0))
            bit, reached = (rows[-1][4] if arrives else out0), into
            if bit:
                wanted.add((key, into))
            # The next chunk of the trader comes no earlier than the one this run reaches.
            chunk = into - 1 if rng.random() < 0.7 else into
    table = spark.createDataFrame(rows, "k int, chunk long, into long, out0 int, out1 int")
    assert {tuple(r) for r in carried_bits(table, ["k"], fanout).collect()} == wanted
    assert carried_bits(table.limit(0), ["k"]).count() == 0


def test_pattern_records(table):
    records = wash_patterns(table(FOUR))
    flat = flat_patterns(records).first()
    assert flat["related_tx_hashes"] == ",".join(tx(n) for n in range(1, 9))
    assert (flat["trade_count"], flat["round_trip_count"], flat["time_window_seconds"]) == (8, 4, 210)
    assert with_pattern_errors(records).first()[ERRORS] == []
    rollup = wash_pattern_rollup(records).first()
    assert (rollup["total_candidates"], rollup["high_confidence_count"], rollup["roundtrip_count"]) == (1, 1, 1)
    assert rollup["total_volume_usd"] == Decimal(8000)


def test_candidate_rules(table):
    found = wash_trades(table(FOUR))
    assert with_wash_errors(found).first()[ERRORS] == []
    bad = found.withColumns({"roundtrip_count": F.lit(2), "first_tx": F.lit("0x1")})
    assert with_wash_errors(bad).first()[ERRORS] == [
        "roundtrip_count: below 3",
        "first_tx: not a transaction hash",
    ]
    loose = found.withColumn("first_tx", F.lit("0x" + "g" * 64))
    assert with_wash_errors(loose).first()[ERRORS] == []
