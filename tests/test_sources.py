import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import POOL, T0, address, swap, tx
from tidewatch.operators import cleaning, quality
from tidewatch.operators.filters import by_pool, by_sender, min_usd, pool_time_range
from tidewatch.operators.sandwich import SandwichSettings, tradable_swaps
from tidewatch.plans import jobs
from tidewatch.schemas import SWAP_COLUMNS
from tidewatch.sources import parquet, raw_json
from tidewatch.streaming.landing import start_landing, start_rejected

PAYLOAD = {
    "id": tx(1) + "#3",
    "timestamp": str(T0),
    "sender": address(1),
    "recipient": address(2),
    "amount0": "-1.50",
    "amount1": "2",
    "amountUSD": "99.9",
    "tick": "-5",
    "sqrtPriceX96": "79228162514264337593543950336",
    "pool": {"id": POOL},
    "transaction": {"id": tx(1), "blockNumber": "24305113"},
}


def normalised(spark, tmp_path, *payloads):
    path = tmp_path / "landed.json"
    path.write_text("\n".join(json.dumps(p) for p in payloads))
    return raw_json.normalise_payloads(raw_json.read_payloads(spark, str(path))).collect()


def test_nested_payload(spark, tmp_path):
    (row,) = normalised(spark, tmp_path, PAYLOAD)
    assert row.asDict() == {
        "timestamp": T0, "block_number": 24305113, "tx_hash": tx(1), "pool": POOL, "sender": address(1),
        "recipient": address(2), "amount0": "-1.50", "amount1": "2", "amount_usd": "99.9", "tick": -5,
        "sqrtPriceX96": "79228162514264337593543950336",
    }


def test_payload_variants(spark, tmp_path):
    cases = [
        ({"pool": POOL}, "pool", POOL),
        ({"pool": {"address": POOL}}, "pool", POOL),
        ({"pool": {"id": "", "address": POOL}}, "pool", POOL),
        ({"pool": None}, "pool", None),
        ({"pool": ""}, "pool", None),
        ({"transaction": None}, "tx_hash", tx(1) + "#3"),
        ({"transaction": None, "transactionHash": tx(4)}, "tx_hash", tx(4)),
        ({"transaction": {"id": ""}, "transactionHash": tx(4)}, "tx_hash", tx(4)),
        ({"transaction": None, "blockNumber": "7"}, "block_number", 7),
        ({"transaction": {"id": tx(1)}, "blockNumber": 7}, "block_number", 7),
        ({"timestamp": "soon"}, "timestamp", None),
        ({"timestamp": T0}, "timestamp", T0),
        ({"tick": "1.5"}, "tick", None),
        ({"sender": ""}, "sender", None),
        ({"amountUSD": None}, "amount_usd", None),
    ]
    # The recipient carries the number of the case.
    payloads = [{**PAYLOAD, **changes, "recipient": str(i)} for i, (changes, _, _) in enumerate(cases)]
    rows = {int(row["recipient"]): row for row in normalised(spark, tmp_path, *payloads)}
    assert [rows[i][column] for i, (_, column, _) in enumerate(cases)] == [value for _, _, value in cases]


def test_fetch_job_and_stream_agree(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.json").write_text(json.dumps(PAYLOAD) + "\n")
    jobs.fetch_job(spark, str(landed), str(tmp_path / "batch"))
    batch = parquet.read_swaps(spark, str(tmp_path / "batch")).drop("day")
    assert batch.columns == SWAP_COLUMNS
    paths = [str(landed), str(tmp_path / "stream"), str(tmp_path / "progress")]
    start_landing(spark, *paths).awaitTermination(120)
    (landed / "b.json").write_text(json.dumps({**PAYLOAD, "tick": "6"}) + "\n")
    start_landing(spark, *paths).awaitTermination(120)
    streamed = parquet.read_swaps(spark, paths[1])
    assert sorted(r["tick"] for r in streamed.collect()) == [-5, 6]
    assert streamed.where("tick = -5").collect() == batch.collect()


def test_swaps_are_split_by_day_and_filters_reach_the_scan(spark, table, tmp_path):
    rows = cleaning.clean_swaps(table([swap(n, 1, n * 86400, -1, 1) for n in range(4)]))
    path = str(tmp_path / "swaps")
    parquet.write_swaps(cleaning.project_canonical(rows), path)
    parquet.write_swaps(cleaning.project_canonical(rows), path)
    back = parquet.read_swaps(spark, path)
    assert back.count() == 4
    some = pool_time_range(back, POOL, T0, T0 + 86400).select("tx_hash", "timestamp")
    assert some.count() == 2
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    plan = some._jdf.queryExecution().explainString(modes.fromString("formatted"))
    lines = {line.split(":")[0].strip(): line for line in plan.splitlines()}
    assert "day#" in lines["PartitionFilters"]
    assert "GreaterThanOrEqual(timestamp" in lines["PushedFilters"] and "EqualTo(pool" in lines["PushedFilters"]
    assert "amount0" not in lines["ReadSchema"]


def test_clean_job(spark, table, tmp_path):
    good, bad = swap(1, 1, 0, -1, 1, "50"), swap(2, 1, 1, -1, 1, "5000", pool="0xinvalid")
    raw = str(tmp_path / "raw")
    parquet.write_table(table([good, good, bad]), raw)
    out = jobs.CleanPaths(str(tmp_path / "clean"), str(tmp_path / "report"))
    jobs.clean_job(spark, raw, out)
    assert spark.read.parquet(out.swaps).count() == 2
    text = "\n".join(r[0] for r in spark.read.text(out.report).collect())
    assert "Invalid: 1" in text and "Duplicates: 1" in text and "pool: not an address" in text
    strict = jobs.CleanPaths(str(tmp_path / "c2"), str(tmp_path / "r2"), str(tmp_path / "bad"))
    with pytest.raises(jobs.InvalidRows):
        jobs.clean_job(spark, raw, strict, min_usd=10, strict=True)
    assert spark.read.parquet(strict.swaps).count() == 1
    assert spark.read.parquet(strict.rejected).count() == 1


def test_detector_jobs(spark, table, tmp_path):
    rows = [swap(1, 1, 0, -1000, 1, 1000), swap(2, 2, 1, 5000, -5, 5000), swap(3, 1, 2, 1100, -1, 1100)]
    rows += [swap(10 + i, 5, 1000 + 30 * i, (-1) ** (i + 1) * 1000, (-1) ** i, 1000) for i in range(8)]
    path = str(tmp_path / "swaps")
    parquet.write_swaps(cleaning.clean_swaps(table(rows)), path)

    def run(job, name, minimum):
        found = job(spark, path, str(tmp_path / name), str(tmp_path / f"{name}.md"), min_confidence=minimum)
        text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / f"{name}.md")).collect())
        return found.collect(), text

    found, text = run(jobs.sandwich_job, "sandwich", 0.0)
    assert len(found) == 1 and "Candidates: 1" in text and "0x88e6a0c2...fcb3f5640"[:12] in text
    found, text = run(jobs.sandwich_job, "sandwich2", 0.95)
    assert found == [] and "Candidates: 1" in text
    found, text = run(jobs.wash_job, "wash", 0.5)
    assert len(found) == 1 and "Suspicious volume: 8,000.00 USD" in text
    found, text = run(jobs.wash_job, "wash2", 0.99)
    assert found == [] and "No candidates match." in text


def test_broken_lines_are_kept_apart(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    good = '{"id": "0x1#0", "timestamp": "1700000000", "pool": {"id": "0xa"}}'
    broken = ['{"id": "0x2", "timest', "no json", "5", '"text"']
    (landed / "a.json").write_text("\n".join([good, *broken, "", "  ", f"[{good}, {good}]"]) + "\n")
    raw = str(tmp_path / "raw")
    assert jobs.fetch_job(spark, str(landed), raw) == len(broken)
    assert [r.pool for r in spark.read.parquet(raw).collect()] == ["0xa"] * 3
    assert sorted(r.line for r in spark.read.parquet(f"{raw}-rejected").collect()) == sorted(broken)
    paths = [str(tmp_path / name) for name in ["stream", "check", "stream-rejected", "check-rejected"]]
    start_landing(spark, str(landed), *paths[:2], by_day=True).awaitTermination(120)
    start_rejected(spark, str(landed), *paths[2:]).awaitTermination(120)
    stream = spark.read.parquet(paths[0])
    assert stream.count() == 3 and "day" in stream.columns
    assert sorted(r.line for r in spark.read.parquet(paths[2]).collect()) == sorted(broken)


def scan_rows(df):
    """Rows that the scans of a collected result have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, open_nodes = 0, [plan]
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().get("numOutputRows").get().value()
        children = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else []
        children += [node.plan()] if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")) else []
        it = node.children().iterator()
        while it.hasNext():
            children.append(it.next())
        open_nodes += children
    return found


def test_one_pool_or_sender_skips_row_groups_and_a_minimum_reaches_the_scan(spark, table, tmp_path):
    rows = [swap(i, i % 97, i // 50, -1, 1, str(i % 1000), pool=address(i % 40)) for i in range(4000)]
    path = str(tmp_path / "swaps")
    spark.conf.set("spark.hadoop.parquet.block.size", "20000")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "20000")
    try:
        parquet.write_swaps(cleaning.project_canonical(table(rows)), path)
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.unset("spark.hadoop.parquet.block.size")
    stored = spark.read.parquet(path)
    one_pool = by_pool(stored, address(3)).select("tx_hash")
    assert one_pool.count() == 100 and scan_rows(one_pool) < 1000
    nobody = by_sender(stored, address(55555)).select("tx_hash")
    # Between the least and the greatest sender of every row group: only the Bloom filters can tell.
    inside = by_sender(stored, address(50) [:-1] + "x").select("tx_hash")
    assert scan_rows(nobody) == 0 and scan_rows(inside) == 0
    large = min_usd(stored, 990.0).select("tx_hash")
    assert large.count() == 40
    modes = spark._jvm.org.apache.spark.sql.execution.ExplainMode
    for frame in (large, tradable_swaps(stored, SandwichSettings(min_usd=990.0)).select("seq")):
        assert "GreaterThanOrEqual(amount_usd_double,990.0)" in frame._jdf.queryExecution().explainString(modes.fromString("formatted"))
    back = parquet.read_swaps(spark, path)
    assert back.drop("day").columns == SWAP_COLUMNS


def test_elements_that_are_no_payload_are_kept_apart(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    good = '{"id": "0x1#0", "timestamp": "1700000000", "pool": {"id": "0xa"}}'
    broken = [f"[null, {good}]", "{}", "[{}]", "[null]", '{"other": 1}', '{"transaction": {}}']
    (landed / "a.json").write_text("\n".join([good, *broken, "[]"]) + "\n")
    raw = str(tmp_path / "raw")
    assert jobs.fetch_job(spark, str(landed), raw) == len(broken)
    assert [r.pool for r in spark.read.parquet(raw).collect()] == ["0xa"] * 2
    assert sorted(r.line for r in spark.read.parquet(f"{raw}-rejected").collect()) == sorted(broken)


def test_cleaning_reads_the_raw_table_once(spark, table, tmp_path, monkeypatch):
    rows = [swap(i, i % 5, i, -1, 1, "50") for i in range(40)]
    rows[3]["pool"], rows[4]["amount0"], rows[5]["timestamp"] = "0xinvalid", "many", "soon"
    rows += [dict(rows[0]), {**rows[7], "pool": "  " + rows[7]["pool"].upper().replace("0X", "0x") + " "}]
    raw = str(tmp_path / "raw")
    parquet.write_table(table(rows), raw)
    reads = []
    once = quality.check_once
    monkeypatch.setattr(quality, "check_once", lambda source: reads.append(source) or once(source))
    paths = jobs.CleanPaths(str(tmp_path / "clean"), str(tmp_path / "report"), str(tmp_path / "bad"))
    outcome = jobs.clean_job(spark, raw, paths)
    # All later steps read the checked table, not the raw one.
    assert len(reads) == 1 and not [f for f in outcome.checked.rows.inputFiles() if "/raw/" in f]
    assert scan_rows(reads[0]) == 42
    assert (outcome.checked.total_records, outcome.checked.invalid_records, outcome.duplicates) == (42, 3, 2)
    # The row with blanks and capitals around its pool is a copy once it is normalised.
    assert outcome.kept == 37 and outcome.removed == 5
    assert {r.pool for r in spark.read.parquet(paths.swaps).collect()} == {POOL}
    assert spark.read.parquet(paths.rejected).count() == 3
    numbers = {n[0]: n[1:] for n in outcome.checked.numbers}
    assert numbers["amount_usd"] == (42, 50.0, 50.0, 50.0) and numbers["amount0"][0] == 41 and numbers["timestamp"][0] == 41
    text = "\n".join(r[0] for r in spark.read.text(paths.report).collect())
    assert "## Numeric columns" in text and "| amount_usd | 42 | 50.00 | 50.00 | 50.00 |" in text
    assert "Removed: 5" in text and "Missing columns: none" in text and "Duplicates: 2" in text


def test_cleaning_reports_missing_columns(spark, table, tmp_path):
    raw = str(tmp_path / "raw")
    parquet.write_table(table([swap(i, 1, i, -1, 1) for i in range(3)]).drop("recipient", "tick").withColumn("note", F.lit("x")), raw)
    out = jobs.CleanPaths(str(tmp_path / "clean"), str(tmp_path / "report"))
    outcome = jobs.clean_job(spark, raw, out)
    text = "\n".join(r[0] for r in spark.read.text(out.report).collect())
    assert "Missing columns: recipient, tick" in text and "recipient: not an address" in text
    assert (outcome.checked.valid_records, outcome.kept) == (0, 3)
    empty = str(tmp_path / "empty")
    parquet.write_table(table([]), empty)
    nothing = jobs.clean_job(spark, empty, jobs.CleanPaths(str(tmp_path / "c2"), str(tmp_path / "r2")), strict=True)
    assert (nothing.checked.total_records, nothing.checked.success_rate, nothing.kept, nothing.duplicates) == (0, 100.0, 0, 0)
    assert nothing.checked.numbers[0] == ("timestamp", 0, None, None, None)
