"""Detectors on a stream: replaying a table in files gives what the batch detectors give."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import swap
from tests.test_sandwich import _random_swaps
from tests.test_wash import _random_trades
from tidewatch.operators.cleaning import project_canonical
from tidewatch.operators.sandwich import SandwichSettings, sandwich_candidates
from tidewatch.operators.wash import WashSettings, roundtrips
from tidewatch.streaming.detect import state_settings, stream_roundtrips, stream_sandwiches

pytest.importorskip("google.protobuf")


@pytest.fixture
def replay(spark, table, tmp_path):
    """Rows by batches of files, through a stream, as one table."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.session.timeZone")}
    state_settings(spark)

    def run(batches, build):
        folder, out = str(tmp_path / "in"), str(tmp_path / "out")
        schema = None
        for i, rows in enumerate(batches):
            df = project_canonical(table(rows)).coalesce(1)
            schema = df.schema
            df.write.mode("append").parquet(f"{folder}/part={i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")
        query = build(stream).writeStream.format("parquet").option("path", out)
        query = query.option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out)

    yield run
    for key, value in before.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


def in_batches(rows, n, end):
    """Rows in time order in n batches, and one swap of nobody much later that lets the watermark pass them all."""
    rows = sorted(rows, key=lambda r: int(r["timestamp"]))
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)] + [[end]]


def test_sandwiches_equal_the_batch(table, replay):
    rows = _random_swaps(1)
    settings = SandwichSettings(window_seconds=20)
    end = swap(9000, 77, 100_000, -1000, 1, 1000)
    wanted = sorted(map(tuple, sandwich_candidates(project_canonical(table(rows)), settings).collect()), key=repr)
    got = replay(in_batches(rows, 4, end), lambda s: stream_sandwiches(s, settings, delay_seconds=30))
    assert sorted(map(tuple, got.collect()), key=repr) == wanted and wanted


def test_roundtrips_equal_the_batch(table, replay):
    rows = _random_trades(1, n=160)
    settings = WashSettings(10)
    end = swap(9000, 77, 100_000, -10, 1, 1000)
    columns = ["pool", "sender", "open_tx", "close_tx", "open_timestamp", "close_timestamp", "open_usd", "close_usd", "open_price", "amount_ratio"]
    wanted = sorted(map(tuple, roundtrips(project_canonical(table(rows)), settings).select(*columns).collect()), key=repr)
    got = replay(in_batches(rows, 4, end), lambda s: stream_roundtrips(s, settings, delay_seconds=30))
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == wanted and wanted


def test_late_trades_are_left_out_and_shuffled_ones_are_not(table, replay):
    one = swap(1, 5, 0, -10, 1, 1000)
    two = swap(2, 5, 5, 10, -1, 1000)
    far = swap(3, 6, 500, -10, 1, 1000)
    late = [swap(4, 7, 1, -10, 1, 1000), swap(5, 7, 2, 10, -1, 1000)]
    end = swap(9, 77, 100_000, -10, 1, 1000)
    # The second trade comes first; the late pair comes after the watermark has passed it.
    got = replay([[two], [one], [far], [far | {"tx_hash": far["tx_hash"][:-1] + "f"}], late, [end]], lambda s: stream_roundtrips(s, WashSettings(10), 60))
    assert [(r["open_tx"], r["close_tx"], r["open_usd"]) for r in got.collect()] == [(one["tx_hash"], two["tx_hash"], Decimal(1000))]
    assert got.where(F.col("open_price").isNull()).count() == 0
