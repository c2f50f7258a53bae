import random
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.operators import profiling
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.schemas import SANDWICH_SCHEMA

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]


def candidates(spark, scores_profits):
    rows = [
        (f"0x{i % 3:040x}", f"0x{i:064x}", f"0x{i:064x}", f"0x{i:064x}", "0x" + "a" * 40)
        + (1769263223 + i * 1800, 1769263224 + i * 1800, 1769263225 + i * 1800, 1000.0, 2000.0, 1000.0 + p, p, s)
        for i, (s, p) in enumerate(scores_profits)
    ]
    return spark.createDataFrame(rows, SANDWICH_SCHEMA)


@pytest.mark.parametrize("limit", [1_000_000, 7])
@pytest.mark.parametrize("shape", ["heavy tail", "few values", "negative"])
def test_percentiles(spark, limit, shape):
    rng = random.Random(4)
    draw = {
        "heavy tail": lambda: rng.paretovariate(0.5),
        "few values": lambda: float(rng.randrange(20)),
        "negative": lambda: rng.gauss(-5, 3),
    }[shape]
    values = [draw() for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = exact_percentiles(df, "v", PROBABILITIES, limit)
    assert got == pytest.approx(list(np.quantile(values, PROBABILITIES)), rel=1e-12)


def test_percentiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert exact_percentiles(df.where("v > 5"), "v", [0.5]) == [None]
    assert exact_percentiles(df, "v", [0.1, 0.9], 0) == [3.0, 3.0]


def test_histogram_like_numpy(spark):
    rng = random.Random(2)
    scores = [round(rng.random(), 4) for _ in range(500)] + [0.5] * 20
    got = profiling.histogram(candidates(spark, [(s, 1.0) for s in scores]), "confidence_score")
    rows = got.orderBy("bin").collect()
    counts, edges = np.histogram(scores, bins=50)
    assert [r["n"] for r in rows] == list(counts)
    assert [r["lower"] for r in rows] == pytest.approx(list(edges[:-1]))
    assert rows[-1]["upper"] == edges[-1]


def test_histogram_of_one_value_and_of_nothing(spark):
    one = candidates(spark, [(0.5, 1.0)] * 3)
    rows = profiling.histogram(one, "confidence_score").orderBy("bin").collect()
    assert [r["n"] for r in rows] == list(np.histogram([0.5] * 3, bins=50)[0])
    assert profiling.histogram(one.where("false"), "confidence_score").agg(F.sum("n")).first()[0] == 0


def test_ecdf(spark):
    rows = profiling.confidence_ecdf(candidates(spark, [(0.2, 1.0), (0.2, 1.0), (0.9, 1.0), (0.4, 1.0)]))
    got = {r["confidence_score"]: r["cumulative_percent"] for r in rows.collect()}
    assert got == {0.2: 50.0, 0.4: 75.0, 0.9: 100.0}


def test_profit_and_box(spark):
    found = candidates(spark, [(0.5, float(p)) for p in [0, 1, 2, 3, 100]])
    stats = profiling.profit_stats(found).first()
    assert stats["total_profit_usd"] == Decimal(106) and stats["mean_profit"] == pytest.approx(21.2)
    assert (stats["median_profit"], stats["max_profit"], stats["min_profit"]) == (2.0, 100.0, 0.0)
    box = profiling.box_stats(found).first()
    assert (box["q1"], box["median"], box["q3"]) == (1.0, 2.0, 3.0)
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (0.0, 3.0, 1)
    assert profiling.cap_outliers(found).count() == 4
    nothing = found.where("false")
    assert profiling.profit_stats(nothing).first()["total_profit_usd"] == 0
    assert profiling.box_stats(nothing).first()["median"] is None


def test_profiles_by_attacker_and_pool(spark):
    found = candidates(spark, [(0.5, 10.0), (0.8, 1.0), (0.9, 2.0), (0.7, 5.5)])
    first = profiling.attacker_profile(found).first()
    assert (first["attacker"], first["attack_count"]) == (f"0x{0:040x}", 2)
    assert first["total_profit_usd"] == Decimal("15.5") and first["avg_confidence"] == pytest.approx(0.6)
    assert profiling.sandwich_by_pool(found).first()["candidates"] == 4
    assert [r["confidence_score"] for r in profiling.top_sandwiches(found, 2).collect()] == [0.9, 0.8]
    assert [r["profit_estimate_usd"] for r in profiling.top_cases(found, 5, 0.8).collect()] == [2.0, 1.0]
    metrics = profiling.detection_metrics(found, found.limit(0)).first()
    assert (metrics["detection_rate_percent"], metrics["high_confidence_percent"]) == (0.0, 75.0)


def test_times_are_utc_in_any_session_zone(spark):
    df = spark.createDataFrame([(1704067199,), (1704067200 + 5400,)], "s long")
    got = df.select(
        labels.epoch_to_timestamp(F.col("s")).alias("t"),
        labels.hour_of_day(F.col("s")).alias("h"),
        labels.utc_date(F.col("s")).alias("d"),
        labels.floor_hour(F.col("s")).alias("f"),
    ).collect()
    assert tuple(got[0]) == (datetime(2023, 12, 31, 23, 59, 59), 23, date(2023, 12, 31), datetime(2023, 12, 31, 23))
    assert tuple(got[1]) == (datetime(2024, 1, 1, 1, 30), 1, date(2024, 1, 1), datetime(2024, 1, 1, 1))


def test_peaks_take_the_first_on_ties(spark):
    found = candidates(spark, [(0.5, 1.0)] * 4)
    peak = profiling.peak_hour_day(found).first()
    # 14:00:24, 14:30:24, 15:00:24, 15:30:24 UTC
    assert (peak["peak_hour"], peak["peak_hour_attacks"], peak["peak_day_attacks"]) == (14, 2, 4)
    assert peak["peak_day"] == date(2026, 1, 24)


def test_numeric_summary_skips_text(spark):
    df = spark.createDataFrame([(1, "9", 0.5), (3, "9", None)], "a long, b string, c double")
    got = {r["column"]: (r["min"], r["max"], r["mean"], r["total_rows"]) for r in profiling.numeric_summary(df).collect()}
    assert got == {"a": (1.0, 3.0, 2.0, 2), "c": (0.5, 0.5, 0.5, 2)}
