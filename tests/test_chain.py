"""Jobs one after the other with their defaults, and order keys stored as text."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import POOL, PRICE, T0, address, swap, tx
from tidewatch.operators.cleaning import dedup_swaps
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.operators.sandwich import sandwich_candidates
from tidewatch.operators.wash import WashSettings, roundtrips
from tidewatch.plans import jobs
from tidewatch.schemas import SWAP_SCHEMA
from tidewatch.session import shared_folder
from tidewatch.sources import parquet, reports


def payload(n, sender, seconds, amount0, amount1, usd):
    return json.dumps(
        {
            "id": f"{tx(n)}#1", "timestamp": str(T0 + seconds), "sender": address(sender), "recipient": address(99),
            "amount0": str(amount0), "amount1": str(amount1), "amountUSD": str(usd), "tick": "196433", "sqrtPriceX96": PRICE,
            "pool": {"id": POOL}, "transaction": {"id": tx(n), "blockNumber": str(24305113 + n)},
        }
    )


def test_fetch_clean_detect(spark, tmp_path):
    lines = [payload(1, 1, 0, -1000, 1, 1000), payload(2, 2, 1, 5000, -5, 5000), payload(3, 1, 2, 1100, -1.1, 1100)]
    lines += [payload(10 + i, 5, 1000 + 30 * i, (-1) ** (i + 1) * 1000, (-1) ** i, 1000) for i in range(8)]
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.json").write_text("\n".join(lines + lines[:1]))
    landed, raw, clean = (str(tmp_path / name) for name in ("landed", "raw", "clean"))
    jobs.fetch_job(spark, landed, raw)
    jobs.clean_job(spark, raw, jobs.CleanPaths(clean, str(tmp_path / "cleaning")))
    swaps = parquet.read_swaps(spark, clean)
    assert swaps.drop("day").schema == SWAP_SCHEMA and swaps.count() == 11
    assert swaps.where("block_number IS NULL OR tick IS NULL").count() == 0
    found = jobs.sandwich_job(spark, clean, str(tmp_path / "s"), str(tmp_path / "sr"))
    assert found.count() == 1
    assert spark.read.parquet(str(tmp_path / "sr-pools")).count() == 1
    assert jobs.wash_job(spark, clean, str(tmp_path / "w"), str(tmp_path / "wr")).count() == 1


@pytest.mark.parametrize("kind", ["string", "long"])
def test_log_index_counts_as_a_number(spark, table, kind):
    rows = [swap(1, 1, 0, -1000, 1, 1000), swap(1, 2, 0, 5000, -5, 5000), swap(1, 1, 0, 1100, -1, 1100)]
    swaps = table(rows).withColumn("log_index", F.when(F.col("amount0") == "-1000", 8).when(F.col("amount0") == "5000", 9).otherwise(10).cast(kind))
    assert sandwich_candidates(swaps).count() == 1
    pair = table([swap(1, 1, 0, -1000, 1, 1000), swap(1, 1, 0, 1000, -1, 1000), swap(1, 1, 0, 1000, -1, 1000)])
    pair = pair.withColumn("log_index", (F.monotonically_increasing_id() % 3 + 9).cast(kind))
    assert roundtrips(pair, WashSettings()).count() == 1


def test_dedup_keeps_the_smaller_block(table):
    rows = [swap(1, 1, 0, -1, 1, block_number=b) for b in ("10000000", "9999999")]
    assert [r.block_number for r in dedup_swaps(table(rows)).collect()] == ["9999999"]


def test_percentiles_do_not_depend_on_the_limit(spark):
    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.3).alias("x"))
    wanted = exact_percentiles(df, "x", [0.01, 0.25, 0.5, 0.99])
    assert exact_percentiles(df, "x", [0.01, 0.25, 0.5, 0.99], values_per_task=20) == wanted


def test_report_counts_the_pools_it_does_not_list(spark, table):
    rows = []
    for p in range(3):
        rows += [swap(9 * p + i, s, i, a, b, u, pool=address(500 + p)) for i, (s, a, b, u) in enumerate([(1, -1000, 1, 1000), (2, 5000, -5, 5000), (1, 1100, -1, 1100)])]
    swaps = table(rows)
    settings = jobs.SandwichSettings()
    text = reports.sandwich_report(sandwich_candidates(swaps, settings), swaps, settings, pools_listed=2)
    assert "... and 1 more pools" in text


def test_no_machine_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
