"""Scores of the two detectors, as column expressions over doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.parsing import as_double, clamp01, score_round, with_score_round

# Weights and steps of the sandwich score.
TIME_WEIGHT, SIMILARITY_WEIGHT, VICTIM_WEIGHT, RATIO_WEIGHT = 0.35, 0.25, 0.2, 0.2
TIME_STEPS = [(5, 1.0), (15, 0.9), (30, 0.8)]
VICTIM_STEPS = [(10000.0, 1.0), (5000.0, 0.9), (1000.0, 0.8)]
VICTIM_FLOOR = 0.6
RATIO_STEPS = [(0.5, 1.0), (0.3, 0.9), (0.1, 0.7)]
RATIO_FLOOR = 0.5

# Weights of the wash score and the dispersion used when no price is known.
ROUNDTRIP_WEIGHT, DISPERSION_WEIGHT, PACE_WEIGHT = 0.4, 0.4, 0.2
DEFAULT_DISPERSION = 0.1
Q96 = float(2**96)


def _at_least(value: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    result = F.lit(otherwise)
    for bound, factor in reversed(steps):
        result = F.when(value >= bound, F.lit(factor)).otherwise(result)
    return result


def amount_similarity(one: Column, other: Column) -> Column:
    """Smaller over larger amount, null when both are zero."""
    return F.try_divide(F.least(one, other), F.greatest(one, other))


def profit_estimate(front_usd: Column, back_usd: Column) -> Column:
    return F.greatest(back_usd - front_usd, F.lit(0.0))


def pair_points(span_seconds: Column, similarity: Column) -> Column:
    """A pair's part of the score. Not monotonic in time: 30 s scores 0.8 and 31 s scores 0.983."""
    slow = F.greatest(F.lit(0.5), F.lit(1.0) - (span_seconds - 30).cast("double") / F.lit(60.0))
    time = slow
    for bound, factor in reversed(TIME_STEPS):
        time = F.when(span_seconds <= bound, F.lit(factor)).otherwise(time)
    return time * F.lit(TIME_WEIGHT) + similarity * F.lit(SIMILARITY_WEIGHT)


def victim_points(victim_usd: Column) -> Column:
    return _at_least(victim_usd, VICTIM_STEPS, VICTIM_FLOOR) * F.lit(VICTIM_WEIGHT)


def _ratio(victim_usd: Column, front_usd: Column) -> Column:
    return F.when(victim_usd > 0, F.try_divide(front_usd, victim_usd)).otherwise(F.lit(0.0))


def _ratio_points(ratio: Column) -> Column:
    return _at_least(ratio, RATIO_STEPS, RATIO_FLOOR) * F.lit(RATIO_WEIGHT)


def sandwich_confidence(
    span_seconds: Column, similarity: Column, victim_usd: Column, front_usd: Column
) -> Column:
    """0..1 score of a triple."""
    score = pair_points(span_seconds, similarity) + victim_points(victim_usd) + _ratio_points(_ratio(victim_usd, front_usd))
    return score_round(clamp01(score))


def with_triple_score(triples: DataFrame, name: str) -> DataFrame:
    """``sandwich_confidence`` from ``pair_points``, ``victim_points``, ``front_usd`` and ``victim_usd``, as a column.

    Each step is a projection of its own, so that nothing is computed twice for a triple.
    """
    usd, front = F.col("victim_usd"), F.col("front_usd")
    triples = triples.withColumn("_ratio", _ratio(usd, front))
    points = _ratio_points(F.col("_ratio"))
    triples = triples.withColumn("_score", clamp01(F.col("pair_points") + F.col("victim_points") + points))
    return with_score_round(triples, "_score", name).drop("_ratio")


def sqrt_price_to_price(sqrt_price_x96: Column) -> Column:
    """Pool price from its Q64.96 square root. A double: legal values exceed 38 digits."""
    root = as_double(sqrt_price_x96) / F.lit(Q96)
    return root * root


def wash_confidence(
    roundtrips: Column, dispersion: Column, mean_gap: Column, window_seconds: int
) -> Column:
    """0..1 score of a trader. An undefined dispersion (one price only) scores as the worst."""
    count = F.least(
        F.lit(1.0), (roundtrips - 3).cast("double") / F.lit(7.0) + F.lit(0.5)
    )
    steady = F.coalesce(
        F.greatest(F.lit(0.0), F.lit(1.0) - dispersion * F.lit(10.0)), F.lit(0.0)
    )
    pace = F.greatest(
        F.lit(0.5), F.lit(1.0) - mean_gap / F.lit(float(window_seconds)) * F.lit(0.5)
    )
    score = (
        count * F.lit(ROUNDTRIP_WEIGHT)
        + steady * F.lit(DISPERSION_WEIGHT)
        + pace * F.lit(PACE_WEIGHT)
    )
    return score_round(clamp01(score))


def price_dispersion(price: Column, amount_ratio: Column) -> Column:
    """Aggregate: deviation over mean of the prices, else of the amount ratios, else the default."""

    def spread(value: Column) -> Column:
        return F.try_divide(F.stddev_samp(value), F.avg(value))

    return (
        F.when(F.count(price) > 0, spread(price))
        .when(F.count(amount_ratio) > 0, spread(amount_ratio))
        .otherwise(F.lit(DEFAULT_DISPERSION))
    )
