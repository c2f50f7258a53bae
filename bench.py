"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query is run in full: all rows of the result are produced and thrown away. The events are first written as one
file per core, as a large table has many: one file of 2 MB would be read by a single core.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from checks.queries import QUERIES
from tidewatch.session import build_session

HEADLINE = [
    "sandwich_candidates_all",
    "sandwich_hot_pool",
    "sandwich_attacks_hot_pool",
    "reversal_pairs_all",
    "wash_trades_all",
    "roundtrips_all",
    "clean_swaps",
    "dedup_hot_copies",
    "validate_swaps",
    "validation_summary",
    "sandwich_summary",
    "attacker_profile",
    "profit_stats",
    "histogram_50",
    "normalise_raw_swaps",
    "scan_pool_time_range",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    split = tempfile.mkdtemp(prefix="bench-")
    spark.read.parquet(f"{folder}/events.parquet").repartition(int(cpus)).write.parquet(f"{split}/events.parquet")
    # Starting the JVM and loading classes is not part of any query.
    spark.read.parquet(f"{split}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, split).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
