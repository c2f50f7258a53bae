"""Markdown reports. Every number comes from an aggregate or a top-n; only those are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.labels import short_label
from tidewatch.operators import profiling as P
from tidewatch.operators import quality as Q
from tidewatch.operators.sandwich import SandwichSettings
from tidewatch.operators.wash import WashSettings

#: Pools that the page of a report lists; it says how many more there are, and the by-pool table has all.
POOLS_LISTED = 1000


def _table(header: list[str], rows: list[list[str]]) -> list[str]:
    bar = lambda cells: "| " + " | ".join(cells) + " |"
    return [bar(header), bar(["---"] * len(header)), *[bar(row) for row in rows], ""]


def _number(value: float | None) -> str:
    return "N/A" if value is None else f"{value:.2f}"


def cleaning_report(checked: Q.CheckedTable, duplicates: int, kept: int, key: list[str]) -> str:
    """Page on a cleaning run; ``kept`` is the number of rows of the cleaned table."""
    key = [name for name in key if name in checked.columns]
    sample = Q.error_sample(checked.errors(key), key, 5).collect() if checked.invalid_records else []
    lines = [
        "# Swap cleaning report",
        "",
        f"- Rows: {checked.total_records:,}",
        f"- Valid: {checked.valid_records:,}",
        f"- Invalid: {checked.invalid_records:,}",
        f"- Success rate: {checked.success_rate:.2f}%",
        f"- Duplicates: {duplicates:,}",
        f"- Rows after cleaning: {kept:,}",
        f"- Removed: {checked.total_records - kept:,}",
        f"- Columns: {', '.join(checked.columns)}",
        f"- Missing columns: {', '.join(checked.missing) or 'none'}",
        "",
    ]
    if sample:
        lines += ["## Sample errors", ""]
        lines += [f"- {', '.join(str(row[name]) for name in key)}: {row['error']}" for row in sample]
        more = checked.invalid_records - len(sample)
        lines += [f"- ... and {more:,} more"] if more > 0 else []
        lines += [""]
    rows = [[name, f"{n:,}", _number(low), _number(high), _number(mean)] for name, n, low, high, mean in checked.numbers]
    lines += ["## Numeric columns", "", *_table(["Column", "Numbers", "Min", "Max", "Mean"], rows)] if rows else []
    return "\n".join(lines)


def sandwich_report(
    candidates: DataFrame,
    swaps: DataFrame,
    settings: SandwichSettings,
    min_confidence: float = 0.0,
    pools_listed: int = POOLS_LISTED,
) -> str:
    run: Row = P.sandwich_summary(candidates, swaps, settings.window_seconds, settings.min_usd).first()
    lines = [
        "# Sandwich report",
        "",
        f"- Time window: {settings.window_seconds} s",
        f"- Confidence filter of the saved table: {min_confidence:.2f}",
        f"- Swaps analysed: {run['total_swaps_analyzed']:,}",
        f"- Pools analysed: {run['pools_analyzed']:,}",
        f"- Candidates: {run['total_candidates']:,}",
        f"- Attackers: {run['unique_attackers']:,}",
        f"- Candidates at 0.8 or above: {run['high_confidence_count']:,}",
        "",
    ]
    if run["status"]:
        lines += ["## Errors", "", f"- {run['status']}", ""]
    if run["total_candidates"]:
        best = [
            [
                str(row["rank"]), row["attacker"], row["pool"], f"{row['confidence_score']:.2f}",
                _number(row["profit_estimate_usd"]), row["victim"],
            ]
            for row in P.top_sandwiches(candidates).collect()
        ]
        lines += ["## Top candidates", ""]
        lines += _table(["Rank", "Attacker", "Pool", "Confidence", "Profit (USD)", "Victim"], best)
        pools = P.sandwich_by_pool(candidates).withColumn("pool", short_label(F.col("pool")))
        shown = pools.limit(pools_listed).collect()
        lines += ["## By pool", ""]
        lines += _table(
            ["Pool", "Candidates", "Mean confidence", "Profit (USD)"],
            [
                [p["pool"], str(p["candidates"]), f"{p['avg_confidence']:.2f}", f"{p['total_profit_usd']:.2f}"]
                for p in shown
            ],
        )
        more = pools.count() - len(shown)
        if more:
            lines += [f"... and {more:,} more pools; the by-pool table has them all", ""]
    return "\n".join(lines)


def wash_report(
    candidates: DataFrame, swaps: DataFrame, settings: WashSettings, min_confidence: float = 0.0
) -> str:
    run = P.run_counters(swaps).first()
    total = P.wash_report_stats(candidates).first()["candidates"]
    kept = P.wash_report_stats(candidates, min_confidence).first()
    lines = [
        "# Wash trading report",
        "",
        f"- Swaps analysed: {run['total_swaps_analyzed']:,}",
        f"- Pools analysed: {run['pools_analyzed']:,}",
        f"- Time window: {settings.window_seconds} s",
        f"- Minimum USD per trade: {settings.min_usd:,.2f}",
        f"- Minimum roundtrips: {settings.min_roundtrips}",
        f"- Candidates: {total:,}",
        f"- Candidates at {min_confidence:.2f} or above: {kept['candidates']:,}",
        "",
    ]
    if not kept["candidates"]:
        return "\n".join(lines + ["No candidates match.", ""])
    best = [
        [
            row["trader_label"], row["pool_label"], str(row["roundtrip_count"]),
            f"{row['total_volume_usd']:,.2f}", f"{row['avg_roundtrip_time']:.1f}",
            f"{row['confidence_score']:.3f}",
        ]
        for row in P.top_wash(candidates, 10, min_confidence).collect()
    ]
    header = ["Trader", "Pool", "Roundtrips", "Volume (USD)", "Mean time (s)", "Confidence"]
    lines += ["## Top candidates", "", *_table(header, best)]
    lines += [
        "## Statistics",
        "",
        f"- Suspicious volume: {kept['total_volume_usd']:,.2f} USD",
        f"- Mean confidence: {kept['avg_confidence']:.3f}",
        f"- Mean roundtrips: {kept['avg_roundtrips']:.1f}",
        "",
    ]
    return "\n".join(lines)


def save_report(spark: SparkSession, text: str, path: str) -> None:
    """Writes the report through Spark, so that any file system of the cluster will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
