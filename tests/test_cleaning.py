from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import POOL, T0, address, swap, tx
from tidewatch.operators import cleaning, filters
from tidewatch.schemas import SWAP_COLUMNS, SWAP_SCHEMA

ROWS = [
    swap(1, 1, 0, "-100", "0.5", "100.50"),
    swap(2, 2, 1, "200", "-1.0", "200.75"),
    swap(3, 3, 2, "-300", "1.5", "300"),
]


def test_bad_timestamp_is_dropped(table):
    rows = ROWS[:2] + [{**ROWS[2], "timestamp": "invalid"}]
    cleaned = cleaning.clean_swaps(table(rows))
    assert cleaned.count() == 2
    assert dict(cleaned.dtypes)["timestamp"] == "bigint"


def test_timestamp_text(table):
    read = {"1769263223.9": T0, " 12 ": 12, "-1.5": -1, "1e3": 1000, "9007199254740993": 9007199254740993}
    texts = [*read, "", "nan", "inf", "1d", "1_000", None]
    rows = table([{**ROWS[0], "timestamp": text, "tx_hash": text} for text in texts])
    got = cleaning.coerce_timestamp(rows).collect()
    assert {r["tx_hash"]: r["timestamp"] for r in got} == read


def test_addresses_become_lower_case(table):
    row = {**ROWS[0], "pool": POOL.upper(), "sender": None}
    cleaned = cleaning.clean_swaps(table([row])).first()
    assert cleaned["pool"] == POOL and cleaned["sender"] is None


def test_hash_case_and_amount_digits_stay(table):
    rows = [{**ROWS[0], "tx_hash": "0x" + "A" * 64, "amount0": "1.0"}, {**ROWS[0], "tx_hash": "0x" + "A" * 64, "amount0": "1.00"}]
    cleaned = cleaning.clean_swaps(table(rows)).collect()
    assert {r["amount0"] for r in cleaned} == {"1.0", "1.00"}
    assert {r["tx_hash"] for r in cleaned} == {"0x" + "A" * 64}


def test_duplicates_keep_the_first_block(table):
    later = {**ROWS[0], "block_number": "99999999"}
    cleaned = cleaning.clean_swaps(table([later, *ROWS, ROWS[1]]))
    assert cleaned.count() == 3
    assert {r["block_number"] for r in cleaned.collect()} == {r["block_number"] for r in ROWS}


def test_duplicates_in_null_columns(table):
    row = {**ROWS[0], "recipient": None, "amount1": None}
    assert cleaning.clean_swaps(table([row, dict(row)])).count() == 1


def test_pool_is_no_part_of_the_key(table):
    rows = [{**ROWS[0], "pool": "0x" + "b" * 40}, {**ROWS[0], "pool": "0x" + "a" * 40}]
    assert [r["pool"] for r in cleaning.clean_swaps(table(rows)).collect()] == ["0x" + "a" * 40]


def test_absent_columns_are_added(table):
    narrow = table(ROWS).select("timestamp", "sender", "amount0")
    cleaned = cleaning.clean_swaps(narrow)
    assert {"pool", "recipient", "amount1", "tx_hash"} <= set(cleaned.columns)
    assert cleaned.count() == 3
    with pytest.raises(ValueError, match="timestamp"):
        cleaning.clean_swaps(narrow.drop("timestamp"))


def test_only_key_columns(table):
    key = table(ROWS + ROWS).select("tx_hash", "timestamp", "sender", "recipient", "amount0", "amount1")
    assert cleaning.dedup_swaps(key).count() == 3


def test_canonical_projection(table):
    narrow = table(ROWS).drop("tick").withColumn("note", F.lit(1))
    canonical = cleaning.project_canonical(narrow)
    assert canonical.columns == SWAP_COLUMNS
    assert canonical.schema.simpleString() == SWAP_SCHEMA.simpleString()
    assert canonical.first()["tick"] is None
    assert cleaning.project_canonical(narrow.limit(0)).schema.simpleString() == SWAP_SCHEMA.simpleString()


def test_min_usd(table):
    df = table(ROWS + [{**ROWS[0], "amount_usd": text} for text in ("NaN", "1d", None, "1e3")])
    assert filters.min_usd(df, 200.75).count() == 3
    assert filters.min_usd(df, 0) is df
    assert filters.min_usd(df.drop("amount_usd"), 5).columns == df.drop("amount_usd").columns


def test_value_range_is_exact_and_inclusive(table):
    df = table([{**ROWS[0], "amount_usd": text} for text in ("424.108780290392901693", "424.108780290392901692")])
    exact = Decimal("424.108780290392901693")
    assert filters.by_value_range(df, low=exact).count() == 1
    assert filters.by_value_range(df, high=exact).count() == 2
    assert filters.by_value_range(df).count() == 2


def test_pool_sender_and_time(table):
    df = cleaning.clean_swaps(table(ROWS))
    assert filters.by_pool(df, POOL.upper()).count() == 3
    assert filters.by_sender(df, address(2).upper()).count() == 1
    assert [r["tx_hash"] for r in filters.pool_time_range(df, POOL, T0, T0 + 1).collect()] == [tx(1), tx(2)]
    with pytest.raises(ValueError, match="start"):
        filters.pool_time_range(df, POOL, T0 + 1, T0)


def test_swap_values(table):
    row = filters.with_swap_values(table([swap(1, 1, 0, "-423.467818", "0.143747594817866756", "x")])).first()
    assert row["abs_amount0"] == Decimal("423.467818")
    assert row["abs_amount1"] == Decimal("0.143747594817866756")
    assert row["usd_value"] is None


def test_value_range_counts_every_digit(spark):
    texts = ["999." + "9" * 20, "1000", "1000." + "0" * 20 + "1", "1e20", "9" * 25, "-" + "9" * 25, "-1000." + "0" * 19 + "6", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "amount_usd string")
    found = lambda *bounds: [r.amount_usd for r in filters.by_value_range(df, *bounds).collect()]
    thousand = Decimal("1000")
    assert found(thousand) == [texts[1], texts[2], texts[3], texts[4]]
    assert found(None, thousand) == [texts[0], texts[1], texts[5], texts[6]]
    assert found(-thousand, thousand) == [texts[0], texts[1]]
    assert found(thousand, thousand) == [texts[1]]
