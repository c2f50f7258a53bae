"""Data-quality rules: each rule is a column that holds a message when broken, null otherwise."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.functions.parsing import DECIMAL_TEXT, WHOLE_NUMBER_TEXT, as_decimal, as_double
from tidewatch.schemas import (
    ADDRESS_COLUMNS,
    ADDRESS_PATTERN,
    DUPLICATE_COUNT_KEY,
    MAX_BLOCK,
    MAX_TICK,
    MAX_TIMESTAMP,
    MIN_TIMESTAMP,
    NUMBER_COLUMNS,
    SWAP_COLUMNS,
    TX_HASH_PATTERN,
    USD,
    WASH_PATTERN_TYPES,
    missing_columns,
)
from tidewatch.session import written

ERRORS = "quality_errors"
VALID = "is_valid"
COPY_KEY = "copy_key"


def _text(name: str) -> Column:
    return F.trim(F.col(name).cast("string"))


def _broken(ok: Column, message: str) -> Column:
    """The message unless ``ok`` is true; a null outcome counts as broken."""
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))


def _whole_number(name: str, low: int, high: int) -> Column:
    text = _text(name)
    number = text.try_cast("decimal(38,0)")
    return F.when(~F.coalesce(text.rlike(WHOLE_NUMBER_TEXT), F.lit(False)), F.lit(f"{name}: not an integer")).when(
        ~F.coalesce(number.between(low, high), F.lit(False)), F.lit(f"{name}: out of range")
    )


def _timestamp(name: str) -> Column:
    return _whole_number(name, MIN_TIMESTAMP, MAX_TIMESTAMP)


def _address(name: str) -> Column:
    return _broken(F.lower(_text(name)).rlike(ADDRESS_PATTERN), f"{name}: not an address")


def _hash(name: str) -> Column:
    return _broken(F.lower(_text(name)).rlike(TX_HASH_PATTERN), f"{name}: not a transaction hash")


def _loose_hash_ok(text: Column) -> Column:
    """Prefix and length only: candidates take hashes whose digits are not hexadecimal."""
    clean = F.lower(F.trim(text))
    return clean.startswith("0x") & (F.length(clean) == 66)


def _loose_hash(name: str) -> Column:
    return _broken(_loose_hash_ok(F.col(name)), f"{name}: not a transaction hash")


def _decimal(name: str) -> Column:
    text = _text(name)
    ok = F.length(text).between(1, 100) & text.rlike(DECIMAL_TEXT)
    return _broken(ok, f"{name}: not a decimal")


def _sqrt_price(name: str) -> Column:
    """A null price passes: it counts as 0."""
    text = F.coalesce(_text(name), F.lit("0"))
    ok = F.length(text).between(1, 100) & text.rlike("^([+]?[0-9]+|-0+)$")
    return _broken(ok, f"{name}: not a non-negative integer")


def _unit_interval(name: str) -> Column:
    return _broken(as_double(F.col(name)).between(0.0, 1.0), f"{name}: not in 0..1")


def _errors(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def with_swap_errors(df: DataFrame) -> DataFrame:
    """Adds the array of broken rules per swap, in column order; no shuffle, no Python."""
    return df.withColumn(
        ERRORS,
        _errors(
            _timestamp("timestamp"),
            _whole_number("block_number", 0, MAX_BLOCK),
            _hash("tx_hash"),
            _address("pool"),
            _address("sender"),
            _address("recipient"),
            _decimal("amount0"),
            _decimal("amount1"),
            _decimal("amount_usd"),
            _whole_number("tick", -MAX_TICK, MAX_TICK),
            _sqrt_price("sqrtPriceX96"),
        ),
    )


def with_sandwich_errors(df: DataFrame) -> DataFrame:
    return df.withColumn(
        ERRORS,
        _errors(
            _address("attacker"),
            _loose_hash("victim_tx"),
            _loose_hash("front_run_tx"),
            _loose_hash("back_run_tx"),
            _address("pool"),
            _timestamp("front_run_timestamp"),
            _timestamp("victim_timestamp"),
            _timestamp("back_run_timestamp"),
            _decimal("front_run_amount_usd"),
            _decimal("victim_amount_usd"),
            _decimal("back_run_amount_usd"),
            _decimal("profit_estimate_usd"),
            _unit_interval("confidence_score"),
        ),
    )


def with_wash_errors(df: DataFrame) -> DataFrame:
    return df.withColumn(
        ERRORS,
        _errors(
            _address("trader"),
            _address("pool"),
            _broken(F.col("roundtrip_count") >= 3, "roundtrip_count: below 3"),
            _loose_hash("first_tx"),
            _loose_hash("last_tx"),
            _timestamp("first_timestamp"),
            _timestamp("last_timestamp"),
            _broken(_text("total_volume_usd").rlike(DECIMAL_TEXT), "total_volume_usd: not a decimal"),
            _broken(as_double(F.col("avg_roundtrip_time")) >= 0, "avg_roundtrip_time: negative"),
            # An undefined dispersion is a legal value of the score, so null passes.
            F.when(
                F.col("price_variance").isNotNull(),
                _broken(_text("price_variance").rlike(DECIMAL_TEXT), "price_variance: not a decimal"),
            ),
            _unit_interval("confidence_score"),
        ),
    )


def with_pattern_errors(df: DataFrame) -> DataFrame:
    """Rules of the nested wash-pattern record."""
    metric = lambda name: F.col(f"metrics.{name}")
    volume = F.trim(metric("volume_usd_total"))
    optional = lambda value, ok, message: F.when(value.isNotNull(), _broken(ok, message))
    return df.withColumn(
        ERRORS,
        _errors(
            _broken(F.col("detection_type").isin(WASH_PATTERN_TYPES), "detection_type: unknown"),
            _address("primary_address"),
            _broken(
                (F.size("involved_addresses") >= 1)
                & F.forall(
                    "involved_addresses",
                    lambda address: F.coalesce(F.lower(address).rlike(ADDRESS_PATTERN), F.lit(False)),
                ),
                "involved_addresses: empty or not all addresses",
            ),
            _address("pool"),
            optional(F.col("token_pair"), F.length(F.trim("token_pair")) <= 50, "token_pair: too long"),
            _broken(
                (F.size("related_tx_hashes") >= 2)
                & F.forall(
                    "related_tx_hashes", lambda tx: F.coalesce(_loose_hash_ok(tx), F.lit(False))
                ),
                "related_tx_hashes: fewer than 2 or not all transaction hashes",
            ),
            _timestamp("start_timestamp"),
            _timestamp("end_timestamp"),
            _broken(F.col("end_timestamp") >= F.col("start_timestamp"), "end_timestamp: before start"),
            _broken(metric("trade_count") >= 2, "trade_count: below 2"),
            _broken(metric("unique_addresses") >= 1, "unique_addresses: below 1"),
            _broken(metric("time_window_seconds").between(0, 86400), "time_window_seconds: not in 0..86400"),
            optional(metric("round_trip_count"), metric("round_trip_count") >= 1, "round_trip_count: below 1"),
            _broken(metric("avg_trade_interval_seconds") >= 0, "avg_trade_interval_seconds: negative"),
            _broken(
                metric("amount_similarity_score").between(0.0, 1.0), "amount_similarity_score: not in 0..1"
            ),
            _broken(
                F.length(volume).between(1, 100) & (as_double(volume) >= 0),
                "volume_usd_total: not a non-negative decimal",
            ),
            optional(
                metric("counterparty_diversity"),
                metric("counterparty_diversity").between(0.0, 1.0),
                "counterparty_diversity: not in 0..1",
            ),
            _unit_interval("confidence_score"),
            _broken(F.length(F.trim("description")).between(10, 2000), "description: not 10..2000 characters"),
        ),
    )


def first_error() -> Column:
    """First broken rule in field order, null for a valid row."""
    return F.try_element_at(F.col(ERRORS), F.lit(1))


def is_valid() -> Column:
    return F.size(ERRORS) == 0


def validation_errors(checked: DataFrame, key: list[str]) -> DataFrame:
    """Invalid rows with their first error; rows are named by ``key``, they have no position."""
    return checked.where(~is_valid()).select(*key, first_error().alias("error"))


def error_sample(errors: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    return errors.orderBy(*key, "error").limit(n)


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their errors)."""
    return checked.where(is_valid()).drop(ERRORS), checked.where(~is_valid())


def validation_summary(checked: DataFrame) -> DataFrame:
    """One row of counts; an empty table is 100 % valid."""
    total = F.count(F.lit(1))
    valid = F.count_if(is_valid())
    return checked.agg(
        total.alias("total_records"),
        valid.alias("valid_records"),
        (total - valid).alias("invalid_records"),
        F.coalesce(F.try_divide(valid.cast("double"), total.cast("double")) * 100, F.lit(100.0)).alias(
            "success_rate"
        ),
        (total == valid).alias("is_valid"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each key. Copies collapse to one partial count per task."""
    key = [name for name in DUPLICATE_COUNT_KEY if name in df.columns]
    if not key:
        return df.agg(F.lit(0).cast("bigint").alias("duplicate_count"))
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))


def schema_findings(df: DataFrame) -> DataFrame:
    """Missing and unexpected columns, with the number of rows they touch.

    An unexpected column makes every row illegal; it is reported once here, not once per row.
    """
    missing = [("missing", name) for name in missing_columns(df, SWAP_COLUMNS)]
    unexpected = [("unexpected", name) for name in sorted(set(df.columns) - set(SWAP_COLUMNS))]
    findings = F.array(
        *[F.struct(F.lit(kind).alias("finding"), F.lit(name).alias("column")) for kind, name in missing + unexpected]
    )
    if not missing + unexpected:
        findings = F.expr("array_repeat(struct('' as finding, '' as column), 0)")
    return (
        df.agg(F.count(F.lit(1)).alias("affected_rows"))
        .select(F.explode(findings).alias("f"), "affected_rows")
        .select("f.finding", "f.column", "affected_rows")
    )


def unusable_rows(df: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(job, missing, rows): required columns that ``df`` lacks, per job, and the rows which that job cannot use."""
    gaps = [(job, name) for job, names in sorted(required.items()) for name in missing_columns(df, names)]
    listed = F.array(*[F.struct(F.lit(job).alias("job"), F.lit(name).alias("missing")) for job, name in gaps])
    if not gaps:
        listed = F.expr("array_repeat(struct('' as job, '' as missing), 0)")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(listed).alias("g"), "rows").select("g.job", "g.missing", "rows")


def amounts_consistent(amount0: Column, amount1: Column) -> Column:
    """Opposite signs; false when either cannot be read or is zero."""
    one, other = as_double(amount0), as_double(amount1)
    return F.coalesce(((one > 0) & (other < 0)) | ((one < 0) & (other > 0)), F.lit(False))


def usd_value_valid(amount_usd: Column, minimum: Decimal = Decimal("0")) -> Column:
    """Readable and strictly above the minimum, unlike the filters, which include it."""
    return F.coalesce(as_decimal(amount_usd) > F.lit(str(minimum)).cast(USD), F.lit(False))


# --- everything about a raw table from one pass over it -------------------------------------------


@dataclass(frozen=True)
class CheckedTable:
    """A raw table after one pass: its rows with the errors of each, and what was counted on the way."""

    #: Columns of the source, ``quality_errors``, ``is_valid`` and ``copy_key`` (two hashes of what makes a copy).
    rows: DataFrame
    columns: list[str]
    missing: list[str]
    total_records: int
    valid_records: int
    #: Per column of numbers, as (column, readable values, min, max, mean); text that is no number is left out.
    numbers: list[tuple[str, int, float | None, float | None, float | None]]

    @property
    def invalid_records(self) -> int:
        return self.total_records - self.valid_records

    @property
    def success_rate(self) -> float:
        return 100.0 * self.valid_records / self.total_records if self.total_records else 100.0

    def source_rows(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def valid_rows(self) -> DataFrame:
        return self.rows.where(VALID).select(*self.columns)

    def rejected_rows(self) -> DataFrame:
        return self.rows.where(f"NOT {VALID}").select(*self.columns, ERRORS)

    def errors(self, key: list[str]) -> DataFrame:
        return validation_errors(self.rows.where(f"NOT {VALID}"), key)

    def duplicates(self) -> DataFrame:
        """As ``duplicate_count``, from the hashes that the pass has written: 16 bytes a row are shuffled."""
        per_key = self.rows.where(f"{COPY_KEY} IS NOT NULL").groupBy(COPY_KEY).agg(F.count(F.lit(1)).alias("n"))
        return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"))


def _copy_key(df: DataFrame) -> Column:
    """128 bits of the columns that make a row a copy of another one; null without such columns."""
    key = [name for name in DUPLICATE_COUNT_KEY if name in df.columns]
    if not key:
        return F.lit(None).cast("struct<h1: bigint, h2: bigint>")
    parts = [c for name in key for c in (F.col(name).isNull(), F.col(name))]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def check_once(source: DataFrame) -> CheckedTable:
    """Checks all rows of a raw swap table, reading it once.

    The checked rows are written to the shared folder, with the sums observed on that write; whatever needs the rows later
    reads that table. A required column that is missing is null, and so an error, in every row.
    """
    missing = missing_columns(source, SWAP_COLUMNS)
    present = source.withColumns({name: F.lit(None).cast("string") for name in missing})
    checked = with_swap_errors(present).withColumn(VALID, is_valid()).withColumn(COPY_KEY, _copy_key(source))
    checked = checked.select(*source.columns, ERRORS, VALID, COPY_KEY)
    counted = [name for name in NUMBER_COLUMNS if name in source.columns]
    numbers = {name: as_double(F.col(name).cast("string")) for name in counted}
    seen = Observation()
    observed = checked.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(VALID).alias("valid"),
        *[
            how(value).alias(f"{what}_{name}")
            for name, value in numbers.items()
            for what, how in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
    )
    rows = written(observed, "checked")
    got = seen.get
    summary = [(name, *(got[f"{what}_{name}"] for what in ("n", "min", "max", "mean"))) for name in counted]
    return CheckedTable(rows, source.columns, missing, got["total"], got["valid"], summary)


def normalised(df: DataFrame) -> DataFrame:
    """Text without blanks at its ends; addresses and hashes in lower case: what a valid row is handed on as."""
    lowered = [name for name in [*ADDRESS_COLUMNS, "tx_hash"] if name in df.columns]
    text = {f.name: F.trim(f.name) for f in df.schema.fields if f.dataType.typeName() == "string" and f.name in SWAP_COLUMNS}
    return df.withColumns({name: F.lower(F.trim(F.col(name).cast("string"))) if name in lowered else value for name, value in text.items()})
