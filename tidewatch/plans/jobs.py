"""The four batch jobs. Detector results are cut (written once) before the reports read them, so
no detector plan is evaluated twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import filters, quality
from tidewatch.operators.cleaning import clean_swaps, project_canonical
from tidewatch.operators.profiling import sandwich_by_pool, wash_sorted
from tidewatch.operators.sandwich import SandwichSettings, sandwich_candidates
from tidewatch.operators.wash import WashSettings, wash_trades
from tidewatch.schemas import SANDWICH_SCHEMA, SWAP_COLUMNS, WASH_SCHEMA
from tidewatch.session import cut
from tidewatch.sources import parquet, raw_json, reports


class InvalidRows(RuntimeError):
    """Strict cleaning found invalid rows. The outputs have been written."""


@dataclass(frozen=True)
class CleanPaths:
    swaps: str
    report: str
    rejected: str | None = None


@dataclass(frozen=True)
class CleanOutcome:
    """What a cleaning run found: the checked table, copies, and rows of the cleaned table."""

    checked: quality.CheckedTable
    duplicates: int
    kept: int

    @property
    def removed(self) -> int:
        return self.checked.total_records - self.kept


def fetch_job(spark: SparkSession, landed: str, swaps: str, rejected: str | None = None) -> int:
    """Landed JSON payloads to a swap table in canonical column order.

    Lines that are no JSON object go to the table ``rejected`` (``swaps`` + ``-rejected`` by default). Returns their number.
    """
    lines = raw_json.read_lines(spark, landed)
    parquet.write_swaps(project_canonical(raw_json.normalise_payloads(raw_json.parse_payloads(lines))), swaps)
    rejected = rejected or f"{swaps.rstrip('/')}-rejected"
    parquet.write_table(raw_json.broken_lines(lines), rejected)
    return spark.read.schema("line string").parquet(rejected).count()


def clean_job(
    spark: SparkSession,
    raw: str,
    out: CleanPaths,
    min_usd: float = 0.0,
    strict: bool = False,
) -> CleanOutcome:
    """Validates and cleans, reading the raw table once. Invalid rows are reported; they leave the cleaned table only where
    ``rejected`` names a table to quarantine them in, and then valid ones are normalised. The cleaned table has the canonical typed columns."""
    stored = spark.read.parquet(raw)
    source = stored.select(*[F.col(name).cast("string").alias(name) for name in SWAP_COLUMNS if name in stored.columns])
    checked = quality.check_once(source)
    kept = checked.source_rows()
    if out.rejected:
        kept = quality.normalised(checked.valid_rows())
        parquet.write_table(checked.rejected_rows(), out.rejected)
    cleaned = filters.min_usd(clean_swaps(kept), min_usd)
    seen = Observation()
    parquet.write_swaps(project_canonical(cleaned).observe(seen, F.count(F.lit(1)).alias("n")), out.swaps)
    outcome = CleanOutcome(checked, checked.duplicates().first()["duplicate_count"], seen.get["n"])
    reports.save_report(spark, reports.cleaning_report(checked, outcome.duplicates, outcome.kept, ["tx_hash", "timestamp"]), out.report)
    if strict and checked.invalid_records:
        raise InvalidRows("invalid rows found; see the report")
    return outcome


def sandwich_job(
    spark: SparkSession,
    swaps: str,
    candidates: str,
    report: str,
    settings: SandwichSettings = SandwichSettings(),
    min_confidence: float = 0.0,
) -> DataFrame:
    """Saves the candidates that reach ``min_confidence``; the report covers all of them, and all pools are in the
    table ``report`` + ``-pools``."""
    source = _swaps(spark, swaps)
    found = cut(sandwich_candidates(source, settings))
    parquet.write_table(filters.min_confidence(found, min_confidence), candidates)
    text = reports.sandwich_report(found, source, settings, min_confidence)
    reports.save_report(spark, text, report)
    parquet.write_table(sandwich_by_pool(found), f"{report}-pools")
    return spark.read.schema(SANDWICH_SCHEMA).parquet(candidates)


def wash_job(
    spark: SparkSession,
    swaps: str,
    candidates: str,
    report: str,
    settings: WashSettings = WashSettings(),
    min_confidence: float = 0.0,
) -> DataFrame:
    """Saves the candidates that reach ``min_confidence``, best first; the report names both counts."""
    source = _swaps(spark, swaps)
    found = cut(wash_trades(source, settings))
    kept = filters.min_confidence(found, min_confidence)
    parquet.write_table(wash_sorted(kept), candidates)
    text = reports.wash_report(found, source, settings, min_confidence)
    reports.save_report(spark, text, report)
    return spark.read.schema(WASH_SCHEMA).parquet(candidates)


def _swaps(spark: SparkSession, path: str) -> DataFrame:
    """A swap table as this library or others wrote it: amounts may be text or numbers."""
    return spark.read.parquet(path)
