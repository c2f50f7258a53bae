import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels, parsing, scoring


def test_rounding_is_that_of_exact_values(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, 0.5, 0.03125, 0.15625, 0.00005, 0.99995, 0.62045]
    values += [(2 * k + 1) / 20000 for k in range(10000)]
    ulps = [2.0**-53, 2.0**-54]
    values += [v + rng.choice([-1, 1]) * rng.choice(ulps) for v in values[8:]]
    values += [rng.random() for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(2)
    got = df.select("v", parsing.score_round(F.col("v")).alias("r")).collect()
    wrong = [(v, r, round(v, 4)) for v, r in got if r != round(v, 4)]
    assert wrong == []


def test_doubles_from_text(spark):
    read = {"12": 12.0, " -1.5 ": -1.5, ".5": 0.5, "5.": 5.0, "+1e-3": 0.001, "1E99": 1e99}
    bad = ["", " ", "NaN", "inf", "-Infinity", "1d", "1f", "1_000", "0x10", "1e100", "1 2", None]
    df = spark.createDataFrame([(text,) for text in [*read, *bad]], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", parsing.as_double(F.col("t")).alias("d")).collect()}
    assert got == {**read, **dict.fromkeys(bad)}


def test_numbers_skip_the_text(spark):
    df = spark.createDataFrame([(1.5, 2), (float("nan"), 3), (float("inf"), 4)], "d double, n int")
    got = df.select(parsing.double_of(df, "d"), parsing.double_of(df, "n"), parsing.long_of(df, "n")).collect()
    assert [tuple(r) for r in got] == [(1.5, 2.0, 2), (None, 3.0, 3), (None, 4.0, 4)]


def test_directions(spark):
    df = spark.createDataFrame([(-1.0, 1.0), (1.0, -1.0), (1.0, 1.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(labels.trade_direction(a, b), labels.trade_side(a, b), labels.wash_direction(a)).collect()
    assert [r[0] for r in got] == ["buy", "sell", None, None, None]
    assert [r[1] for r in got] == [-2, 2, 0, -1, None]
    assert [r[2] for r in got] == ["buy", "sell", "sell", "sell", "sell"]


def test_sandwich_score(spark):
    cases = [
        (5, 1.0, 10000.0, 5000.0, 1.0),
        (15, 1.0, 5000.0, 1500.0, 0.35 * 0.9 + 0.25 + 0.18 + 0.18),
        (30, 0.5, 1000.0, 100.0, 0.35 * 0.8 + 0.125 + 0.16 + 0.14),
        (31, 0.5, 999.0, 1.0, 0.35 * (1 - 1 / 60) + 0.125 + 0.12 + 0.1),
        (600, 0.0, 0.0, 1.0, 0.35 * 0.5 + 0.12 + 0.1),
    ]
    df = spark.createDataFrame(cases, "s long, a double, v double, f double, wanted double")
    score = scoring.sandwich_confidence(F.col("s"), F.col("a"), F.col("v"), F.col("f"))
    for row in df.select("wanted", score.alias("score")).collect():
        assert row["score"] == pytest.approx(row["wanted"], abs=5.1e-5)


def test_labels_and_price(spark):
    df = spark.createDataFrame([("0x88e6a0c2ddd26feeb64f039a2c41296fcb3f5640", str(2**97))], "a string, p string")
    row = df.select(
        labels.short_label(F.col("a")), labels.short_label(F.col("a"), 6, 4), scoring.sqrt_price_to_price(F.col("p"))
    ).first()
    assert tuple(row) == ("0x88e6a0c2...cb3f5640", "0x88e6...5640", 4.0)
