"""Exact numbers against Python's decimals."""

import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from tests.conftest import swap
from tidewatch.functions.wide import as_wide, wide_abs, wide_key, wide_sums, wide_text
from tidewatch.operators.filters import by_value_range, with_exact_values

getcontext().prec = 500
TEXTS = [
    "0", "-0", "+0.00", "1", "-1", "007.500", "1e40", "-1E+40", "25e-30", "-.5", "5.", ".000", "1.5e3", "-1.5e-3", "9" * 100, "-" + "9" * 99,
    "0." + "0" * 60 + "7", "1e99", "1e-99", "12345678901234567890.123456789012345678901234567890", " 3.25 ", "1e0", "0e5",
]
BROKEN = ["", "abc", "NaN", "1e100", "1_0", None, "1" * 101, "--1", ".", "1e", "0x1"]


def plain(value):
    text = f"{value:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def table_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_text_and_absolute_value(spark):
    wide = as_wide(F.col("t"))
    rows = table_of(spark, TEXTS).select("t", wide_text(wide).alias("x"), wide_text(wide_abs(wide)).alias("a")).collect()
    for r in rows:
        assert r.x == plain(Decimal(r.t.strip())), r.t
        assert r.a == plain(abs(Decimal(r.t.strip()))), r.t
    broken = table_of(spark, BROKEN).select(wide_text(wide).alias("x"), wide_key(wide).alias("k"), wide_text(wide_abs(wide)).alias("a")).collect()
    assert all(tuple(r) == (None, None, None) for r in broken)


def test_keys_sort_as_numbers(spark):
    rng = random.Random(1)
    texts = TEXTS + [f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randint(1, 12))}.{rng.randrange(10**6):0{rng.randint(6, 9)}}" for _ in range(300)]
    rows = table_of(spark, texts).select("t", wide_key(as_wide(F.col("t"))).alias("k")).collect()
    by_key = [Decimal(r.t.strip()) for r in sorted(rows, key=lambda r: r.k)]
    assert by_key == sorted(by_key)
    assert len({r.k for r in rows}) == len({Decimal(r.t.strip()) for r in rows})


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_are_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(k % 7, rng.choice([*TEXTS, "oops", None])) for k in range(400)] + [(8, "1e40"), (8, "-1e40"), (8, "1e-50"), (8, "-2e-50"), (9, "x"), (10, None)]
    rows += [(11, "0.999999999")] * 3 + [(12, "-999999999.5"), (12, "-0.5")]
    df = spark.createDataFrame(rows, "k int, t string")
    wanted = {}
    for k, t in rows:
        number = Decimal(t.strip()) if t and t not in ("oops", "x") else Decimal(0)
        wanted[k] = wanted.get(k, Decimal(0)) + number
    assert {r.k: r.total for r in wide_sums(df, ["k"], "t").collect()} == {k: plain(v) for k, v in wanted.items()}
    plan = wide_sums(df, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert wide_sums(df.limit(0), ["k"], "t").count() == 0


def test_range_and_values_of_swaps(table):
    usd = ["1e40", "100.0000000000000000000000001", "100", "99.99999999999999999999999", "-5", "1e2", "nan", None, "1E-30"]
    swaps = table([swap(i, 1, i, "-" + "9" * 45, "1e-40", "x") | {"amount_usd": u} for i, u in enumerate(usd)])

    def chosen(low=None, high=None):
        found = by_value_range(swaps, low and Decimal(low), high and Decimal(high))
        return sorted(r.amount_usd for r in found.collect())

    assert chosen("100") == sorted(["1e40", usd[1], "100", "1e2"])
    assert chosen(None, "100") == sorted(["100", usd[3], "-5", "1e2", "1E-30"])
    assert chosen("100.00000000000000000000000005", "1e41") == sorted(["1e40", usd[1]])
    assert chosen("1e-30", "1e-30") == ["1E-30"]
    row = with_exact_values(swaps).orderBy("timestamp").first()
    assert (row.usd_exact, row.abs_amount0_exact) == ("1" + "0" * 40, "9" * 45)
    assert row.abs_amount1_exact == "0." + "0" * 39 + "1"
