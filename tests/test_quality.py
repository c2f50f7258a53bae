from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import swap
from tidewatch.operators import quality
from tidewatch.operators.quality import ERRORS

GOOD = swap(1, 1, 0, "-423.467818", "0.143747594817866756", "424.108780290392901693")


VALID = [
    {},
    {"pool": "0X88E6A0C2DDD26FEEB64F039A2C41296FCB3F5640"},
    {"tx_hash": " 0x" + "AB" * 32 + " "},
    {"sqrtPriceX96": None},
    {"sqrtPriceX96": "-0"},
    {"sqrtPriceX96": "9" * 49},
    {"timestamp": "1769263223.0"},
    {"amount0": "1e5"},
    {"tick": "-887272"},
    {"block_number": "100000000"},
]

BROKEN = [
    ({"timestamp": "invalid"}, "timestamp: not an integer"),
    ({"timestamp": "1000000"}, "timestamp: out of range"),
    ({"timestamp": "2000000001"}, "timestamp: out of range"),
    ({"timestamp": None}, "timestamp: not an integer"),
    ({"timestamp": "1769263223.5"}, "timestamp: not an integer"),
    ({"block_number": "-1"}, "block_number: out of range"),
    ({"tx_hash": "invalid_hash"}, "tx_hash: not a transaction hash"),
    ({"tx_hash": "0x" + "g" * 64}, "tx_hash: not a transaction hash"),
    ({"pool": "0xinvalid"}, "pool: not an address"),
    ({"sender": None}, "sender: not an address"),
    ({"recipient": ""}, "recipient: not an address"),
    ({"amount0": "not_a_number"}, "amount0: not a decimal"),
    ({"amount1": "NaN"}, "amount1: not a decimal"),
    ({"amount_usd": ""}, "amount_usd: not a decimal"),
    ({"amount_usd": "1" * 101}, "amount_usd: not a decimal"),
    ({"tick": "1000000"}, "tick: out of range"),
    ({"tick": "9" * 50}, "tick: out of range"),
    ({"sqrtPriceX96": "-123"}, "sqrtPriceX96: not a non-negative integer"),
    ({"sqrtPriceX96": "1.5"}, "sqrtPriceX96: not a non-negative integer"),
]


def test_each_rule(table):
    cases = [(changes, []) for changes in VALID] + [(changes, [message]) for changes, message in BROKEN]
    expected = {}
    for changes, errors in cases:
        row = {**GOOD, **changes}
        expected[tuple(row.values())] = errors
    rows = [dict(zip(GOOD, values, strict=True)) for values in expected]
    got = quality.with_swap_errors(table(rows)).collect()
    assert {tuple(r[name] for name in GOOD): r[ERRORS] for r in got} == expected


def test_first_error_follows_column_order(table):
    checked = quality.with_swap_errors(table([{**GOOD, "tick": "x", "pool": "0x"}]))
    (row,) = quality.validation_errors(checked, ["tx_hash"]).collect()
    assert row["error"] == "pool: not an address"


def test_summary_and_quarantine(table):
    checked = quality.with_swap_errors(table([GOOD, {**GOOD, "timestamp": "1000000"}]))
    summary = quality.validation_summary(checked).first()
    assert (summary["total_records"], summary["valid_records"], summary["invalid_records"]) == (2, 1, 1)
    assert summary["success_rate"] == 50.0 and summary["is_valid"] is False
    valid, invalid = quality.quarantine(checked)
    assert valid.count() == 1 and ERRORS not in valid.columns
    assert invalid.first()["timestamp"] == "1000000"


def test_summary_of_nothing(table):
    summary = quality.validation_summary(quality.with_swap_errors(table([]))).first()
    assert (summary["total_records"], summary["success_rate"], summary["is_valid"]) == (0, 100.0, True)


def test_duplicates_count_on_four_columns(table):
    rows = [GOOD, {**GOOD, "amount0": "7"}, {**GOOD, "sender": None}, {**GOOD, "sender": None}, {**GOOD, "tick": "1"}]
    assert quality.duplicate_count(table(rows)).first()[0] == 3
    assert quality.duplicate_count(table([])).first()[0] == 0
    assert quality.duplicate_count(table(rows).select("tick")).first()[0] == 0


def test_schema_findings(table):
    df = table([GOOD, GOOD])
    assert quality.schema_findings(df).collect() == []
    changed = df.drop("tick").withColumn("note", F.lit(1))
    got = {tuple(r) for r in quality.schema_findings(changed).collect()}
    assert got == {("missing", "tick", 2), ("unexpected", "note", 2)}


def test_amounts_and_values(spark):
    pairs = spark.createDataFrame(
        [("-1", "2"), ("1", "-2"), ("1", "2"), ("0", "-2"), ("x", "1"), (None, "1")], "a string, b string"
    )
    got = [r[0] for r in pairs.select(quality.amounts_consistent(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False, False, False, False]
    usd = spark.createDataFrame([("100",), ("100.000000000000000001",), ("x",)], "u string")
    got = [r[0] for r in usd.select(quality.usd_value_valid(F.col("u"), Decimal("100"))).collect()]
    assert got == [False, True, False]


def test_error_sample_is_small_and_ordered(table):
    checked = quality.with_swap_errors(
        table([{**GOOD, "tick": "x", "tx_hash": f"0x{n:064x}"} for n in range(30, 0, -1)])
    )
    sample = quality.error_sample(quality.validation_errors(checked, ["tx_hash"]), ["tx_hash"]).collect()
    assert [int(r["tx_hash"], 16) for r in sample] == list(range(1, 11))
