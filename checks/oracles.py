"""The same results as plain SQL for DuckDB, written independently of the Spark plans: the sandwich
join is a theta join, the roundtrips use one window per trader, and so on."""

from __future__ import annotations

RANGE_START, RANGE_END = 1704412800, 1705276800

ATTACKER = "(user_id // 150) * 100000 + user_id % 20"
WASHER = "(user_id // 20) * 1000 + (CAST(floor(epoch(ts)) AS BIGINT) // 86400) % 1000"

COLUMNS = (
    'timestamp, block_number, tx_hash, pool, sender, recipient, amount0, amount1, amount_usd, tick, "sqrtPriceX96"'
)
TEXT_COLUMNS = (
    "timestamp, block_number, tx_hash, pool, sender, recipient, CAST(amount0 AS VARCHAR) AS amount0, "
    'CAST(amount1 AS VARCHAR) AS amount1, CAST(amount_usd AS VARCHAR) AS amount_usd, tick, "sqrtPriceX96"'
)


def _swaps(name: str = "swaps", sender: str = ATTACKER) -> str:
    return f"""{name} AS (
  SELECT CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id AS block_number,
    '0x' || lpad(CAST(event_id AS VARCHAR), 64, '0') AS tx_hash,
    '0x' || substr(sha256(event_type || '-' || CAST(user_id // 150 AS VARCHAR)), 1, 40) AS pool,
    '0x' || lpad(CAST({sender} AS VARCHAR), 40, '0') AS sender,
    '0x' || lpad(CAST({sender} AS VARCHAR), 40, '0') AS recipient,
    CAST(CASE WHEN event_id % 2 = 0 THEN -v ELSE v END AS DECIMAL(18,2)) AS amount0,
    CAST(CASE WHEN event_id % 2 = 0 THEN v ELSE -v END * CAST('0.001' AS DECIMAL(4,3)) AS DECIMAL(20,5)) AS amount1,
    CAST(v * 100 AS DECIMAL(20,2)) AS amount_usd,
    CAST(event_id % 1000 AS INTEGER) AS tick,
    CAST(79000 + event_id % 500 AS VARCHAR) || repeat('0', 24) AS "sqrtPriceX96"
  FROM (SELECT *, CAST(value AS DECIMAL(18,2)) AS v FROM events))"""


SWAPS = _swaps()
WASH_SWAPS = _swaps("wswaps", WASHER)

_UPPER = "'0x' || upper(substr({0}, 3))"
RAW = f"""{SWAPS},
raw AS (
  SELECT
    CASE s WHEN 1 THEN 'invalid' WHEN 2 THEN '1000000' ELSE CAST(timestamp AS VARCHAR) END AS timestamp,
    CASE s WHEN 8 THEN '-1' ELSE CAST(block_number AS VARCHAR) END AS block_number,
    CASE s WHEN 4 THEN 'invalid_hash' ELSE tx_hash END AS tx_hash,
    CASE s WHEN 3 THEN '0xinvalid' WHEN 10 THEN {_UPPER.format("pool")} ELSE pool END AS pool,
    CASE s WHEN 10 THEN {_UPPER.format("sender")} ELSE sender END AS sender,
    CASE s WHEN 10 THEN {_UPPER.format("recipient")} ELSE recipient END AS recipient,
    CASE s WHEN 5 THEN 'not_a_number' WHEN 11 THEN ltrim(CAST(amount0 AS VARCHAR), '-') ELSE CAST(amount0 AS VARCHAR) END AS amount0,
    CASE s WHEN 11 THEN ltrim(CAST(amount1 AS VARCHAR), '-') ELSE CAST(amount1 AS VARCHAR) END AS amount1,
    CAST(amount_usd AS VARCHAR) AS amount_usd,
    CASE s WHEN 6 THEN '1000000' ELSE CAST(tick AS VARCHAR) END AS tick,
    CASE s WHEN 7 THEN '-123' ELSE "sqrtPriceX96" END AS "sqrtPriceX96"
  FROM (SELECT *, block_number % 100 AS s FROM swaps),
    LATERAL (SELECT unnest(CASE WHEN s = 9 THEN [1, 2] ELSE [1] END) AS copy))"""

# Rows with all rules of a legal swap, in column order.
_ADDRESS = "regexp_full_match(lower(trim({0})), '0x[a-f0-9]{{40}}')"
_NUMBER = "'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'"


def _rule(ok: str, message: str) -> str:
    return f"CASE WHEN NOT coalesce({ok}, false) THEN '{message}' END"


def _integer_rule(name: str, low: int, high: int) -> str:
    return (
        f"CASE WHEN NOT regexp_full_match(trim({name}), '[+-]?[0-9]+([.]0*)?') THEN '{name}: not an integer' "
        f"WHEN TRY_CAST({name} AS BIGINT) < {low} OR TRY_CAST({name} AS BIGINT) > {high} THEN '{name}: out of range' END"
    )


_RULES = [
    _integer_rule("timestamp", 1438214400, 2000000000),
    _integer_rule("block_number", 0, 100000000),
    _rule("regexp_full_match(lower(trim(tx_hash)), '0x[a-f0-9]{64}')", "tx_hash: not a transaction hash"),
    *[_rule(_ADDRESS.format(c), f"{c}: not an address") for c in ("pool", "sender", "recipient")],
    *[
        _rule(f"length({c}) BETWEEN 1 AND 100 AND regexp_full_match({c}, {_NUMBER})", f"{c}: not a decimal")
        for c in ("amount0", "amount1", "amount_usd")
    ],
    _integer_rule("tick", -887272, 887272),
    _rule("""regexp_full_match("sqrtPriceX96", '[+]?[0-9]+')""", "sqrtPriceX96: not a non-negative integer"),
]
CHECKED = f"""{RAW},
checked AS (
  SELECT *, [e FOR e IN [{", ".join(_RULES)}] IF e IS NOT NULL] AS errors FROM raw)"""

# First row of each key by block, pool and the other columns.
_REST = "block_number, pool, amount_usd, tick, \"sqrtPriceX96\""


def _dedup(source: str, name: str) -> str:
    order = ", ".join(f"{c.strip()} NULLS FIRST" for c in _REST.split(","))
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY tx_hash, timestamp, sender, recipient, amount0, amount1 ORDER BY {order}) AS rn
    FROM {source}) WHERE rn = 1)"""


# Printing rounds the exact binary value.
_ROUND4 = "CAST(format('{{:.4f}}', least(1e0, greatest(0e0, {0}))) AS DOUBLE)"


def _sandwich_score(span: str, similarity: str, victim: str, front: str) -> str:
    time = (
        f"(CASE WHEN {span} <= 5 THEN 1e0 WHEN {span} <= 15 THEN 0.9e0 WHEN {span} <= 30 THEN 0.8e0 "
        f"ELSE greatest(0.5e0, 1e0 - CAST({span} - 30 AS DOUBLE) / 60e0) END)"
    )
    size = (
        f"(CASE WHEN {victim} >= 10000 THEN 1e0 WHEN {victim} >= 5000 THEN 0.9e0 "
        f"WHEN {victim} >= 1000 THEN 0.8e0 ELSE 0.6e0 END)"
    )
    share = f"(CASE WHEN {victim} > 0 THEN {front} / {victim} ELSE 0e0 END)"
    ratio = (
        f"(CASE WHEN {share} >= 0.5e0 THEN 1e0 WHEN {share} >= 0.3e0 THEN 0.9e0 "
        f"WHEN {share} >= 0.1e0 THEN 0.7e0 ELSE 0.5e0 END)"
    )
    return _ROUND4.format(
        f"{time} * 0.35e0 + {similarity} * 0.25e0 + {size} * 0.2e0 + {ratio} * 0.2e0"
    )


def _wash_score(count: str, spread: str, gap: str, window: int) -> str:
    return _ROUND4.format(
        f"least(1e0, CAST({count} - 3 AS DOUBLE) / 7e0 + 0.5e0) * 0.4e0 "
        f"+ coalesce(greatest(0e0, 1e0 - {spread} * 10e0), 0e0) * 0.4e0 "
        f"+ greatest(0.5e0, 1e0 - {gap} / {window}e0 * 0.5e0) * 0.2e0"
    )


def _sandwich(
    window: int = 21600,
    min_usd: str = "1000",
    similarity: str = "0.5e0",
    source: str = "swaps",
    name: str = "sand",
) -> str:
    alike = "least(f.usd, b.usd) / greatest(f.usd, b.usd)"
    return f"""{name}_e AS (
  SELECT *, timestamp AS ts, CAST(amount_usd AS DOUBLE) AS usd,
    CASE WHEN amount0 < 0 AND amount1 > 0 THEN 'buy' WHEN amount0 > 0 AND amount1 < 0 THEN 'sell' END AS dir
  FROM {source} WHERE CAST(amount_usd AS DOUBLE) >= {min_usd}),
{name}_pairs AS (
  SELECT f.pool, f.sender, f.ts AS fts, b.ts AS bts, f.block_number AS fb, b.block_number AS bb,
    f.tx_hash AS ftx, b.tx_hash AS btx, f.usd AS fusd, b.usd AS busd, {alike} AS alike
  FROM {name}_e f JOIN {name}_e b ON f.pool = b.pool AND f.sender = b.sender
  WHERE (f.ts, f.block_number) < (b.ts, b.block_number) AND b.ts - f.ts <= {window}
    AND f.dir <> b.dir AND {alike} >= {similarity}),
{name} AS (
  SELECT p.sender AS attacker, v.tx_hash AS victim_tx, ftx AS front_run_tx, btx AS back_run_tx, p.pool,
    fts AS front_run_timestamp, v.ts AS victim_timestamp, bts AS back_run_timestamp,
    fusd AS front_run_amount_usd, v.usd AS victim_amount_usd, busd AS back_run_amount_usd,
    greatest(busd - fusd, 0e0) AS profit_estimate_usd,
    {_sandwich_score("(bts - fts)", "alike", "v.usd", "fusd")} AS confidence_score
  FROM {name}_pairs p JOIN {name}_e v ON v.pool = p.pool
  WHERE (fts, fb) < (v.ts, v.block_number) AND (v.ts, v.block_number) < (bts, bb) AND v.sender <> p.sender)"""


FOUND = f"{SWAPS},\n{_sandwich()}"


def _roundtrips(
    window: int = 64800, min_usd: str = "500", source: str = "wswaps", price: bool = True
) -> str:
    root = """(CAST("sqrtPriceX96" AS DOUBLE) / 79228162514264337593543950336e0)"""
    value = f"{root} * {root}" if price else "CAST(NULL AS DOUBLE)"
    return f"""t AS (
  SELECT pool, sender, timestamp AS ts, block_number AS b, tx_hash, CAST(amount0 AS DOUBLE) AS a0,
    CAST(amount_usd AS DECIMAL(36,18)) AS usd, {value} AS price,
    CASE WHEN amount0 < 0 THEN 'buy' ELSE 'sell' END AS dir
  FROM {source}),
nxt AS (
  SELECT *, lead(ts) OVER w AS nts, lead(tx_hash) OVER w AS ntx, lead(a0) OVER w AS na0,
    lead(usd) OVER w AS nusd, lead(dir) OVER w AS ndir
  FROM t WINDOW w AS (PARTITION BY pool, sender ORDER BY ts, b)),
edge AS (
  SELECT *, coalesce(dir <> ndir AND nts - ts <= {window} AND usd >= {min_usd} AND nusd >= {min_usd}, false) AS ok
  FROM nxt),
island AS (
  SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY pool, sender ORDER BY ts, b) AS isl FROM edge),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pool, sender, isl ORDER BY ts, b) AS k FROM island WHERE ok),
rt AS (SELECT * FROM placed WHERE k % 2 = 1)"""


def _wash(window: int = 64800, min_usd: str = "500", count: int = 3, price: bool = True) -> str:
    ratio = "CASE WHEN na0 <> 0 THEN abs(a0 / na0) END"
    return f"""{WASH_SWAPS},
{_roundtrips(window, min_usd, price=price)},
trader AS (
  SELECT pool, sender AS trader, count(*) AS roundtrip_count,
    arg_min(tx_hash, (ts, b)) AS first_tx, arg_max(ntx, (ts, b)) AS last_tx,
    min(ts) AS first_timestamp, max(nts) AS last_timestamp,
    CAST(sum(usd + nusd) AS DECIMAL(38,18)) AS total_volume_usd, avg(nts - ts) AS avg_roundtrip_time,
    CASE WHEN count(price) > 0 THEN stddev_samp(price) / avg(price)
      WHEN count({ratio}) > 0 THEN stddev_samp({ratio}) / avg({ratio}) ELSE 0.1e0 END AS price_variance
  FROM rt GROUP BY pool, sender),
wash AS (
  SELECT *, last_timestamp - first_timestamp AS time_span_seconds,
    {_wash_score("roundtrip_count", "price_variance", "avg_roundtrip_time", window)} AS confidence_score
  FROM trader WHERE roundtrip_count >= {count} AND last_timestamp - first_timestamp <= {window})"""


WASH = _wash()
_WASH_OUT = """trader, pool, roundtrip_count, first_tx, last_tx, first_timestamp, last_timestamp,
  CAST(total_volume_usd AS VARCHAR) AS total_volume_usd, round(avg_roundtrip_time, 6) AS avg_roundtrip_time,
  round(price_variance, 6) AS price_variance, confidence_score, time_span_seconds"""

PATTERNS = f"""{WASH},
legs AS (
  SELECT r.pool, r.sender AS trader, list(r.tx_hash || ',' || r.ntx ORDER BY r.ts, r.b) AS txs,
    avg(CAST(least(r.usd, r.nusd) AS DOUBLE) / CAST(greatest(r.usd, r.nusd) AS DOUBLE)) AS alike
  FROM rt r JOIN wash w ON w.pool = r.pool AND w.trader = r.sender GROUP BY r.pool, r.sender),
patterns AS (SELECT w.*, legs.txs, legs.alike FROM wash w JOIN legs USING (pool, trader))"""

_LEGS = """pool, sender, tx_hash AS open_tx, ntx AS close_tx, ts AS open_timestamp, nts AS close_timestamp,
  CAST(usd AS VARCHAR) AS open_usd, CAST(nusd AS VARCHAR) AS close_usd, price AS open_price,
  abs(CASE WHEN na0 <> 0 THEN a0 / na0 END) AS amount_ratio"""

_EXACT = "CAST(coalesce(sum(CAST(CAST({0} AS VARCHAR) AS DECIMAL(36,18))), 0) AS DECIMAL(38,18))"
_PROFIT = _EXACT.format("profit_estimate_usd")
_MEAN_SCORE = "CAST(sum(CAST(confidence_score AS DECIMAL(5,4))) AS DOUBLE) / count(*)"
_LABEL = "substr({0}, 1, 10) || '...' || right({0}, 8)"
_SHORT = "substr({0}, 1, 6) || '...' || right({0}, 4)"
_POOL = "('0x' || substr(sha256('click-0'), 1, 40))"


def _histogram(source: str, column: str) -> str:
    edge = "(lo + CAST({0} AS DOUBLE) * step)"
    return f"""limits AS (
  SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5e0 ELSE min({column}) END AS lo,
    CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5e0 ELSE max({column}) END AS hi
  FROM {source}),
bins AS (SELECT i, lo, hi, (hi - lo) / 50 AS step FROM range(50) r(i), limits),
edges AS (SELECT i, {edge.format("i")} AS lower, CASE WHEN i = 49 THEN hi ELSE {edge.format("(i + 1)")} END AS upper FROM bins)
SELECT CAST(i + 1 AS INTEGER) AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper, (
  SELECT count(*) FROM {source} s WHERE s.{column} >= lower AND (s.{column} < upper OR (i = 49 AND s.{column} <= upper))) AS n
FROM edges"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


_CAPPED = f"{FOUND},\ncapped AS (SELECT * FROM sand WHERE profit_estimate_usd <= (SELECT quantile_cont(profit_estimate_usd, 0.99) FROM sand))"
_HOT_COPIES = f"""{SWAPS},
hot AS (SELECT * REPLACE (
    CASE WHEN c THEN '0x' || repeat('7', 64) ELSE tx_hash END AS tx_hash,
    CASE WHEN c THEN {RANGE_START} ELSE timestamp END AS timestamp,
    CASE WHEN c THEN '0x' || repeat('7', 40) ELSE sender END AS sender,
    CASE WHEN c THEN '0x' || repeat('7', 40) ELSE recipient END AS recipient,
    CASE WHEN c THEN CAST(-1 AS DECIMAL(18,2)) ELSE amount0 END AS amount0,
    CASE WHEN c THEN CAST(1 AS DECIMAL(20,5)) ELSE amount1 END AS amount1)
  FROM (SELECT *, block_number % 3 = 0 AS c FROM swaps)),
{_dedup("hot", "kept")}"""
_HOT_POOL = f"""{SWAPS},
hot AS (SELECT * REPLACE (
    '0x' || repeat('9', 40) AS pool,
    CASE WHEN block_number % 3 = 0 THEN '0x' || repeat('5', 40) ELSE sender END AS sender) FROM swaps),
{_sandwich(7200, "5000", "0.5e0", "hot")}"""
_HOT_DAY = _HOT_POOL.replace(_sandwich(7200, "5000", "0.5e0", "hot"), _sandwich(86400, "10000", "0.5e0", "hot"))
_ATTACKS = """SELECT pool, attacker, front_run_tx, back_run_tx, front_run_timestamp, back_run_timestamp,
  front_run_amount_usd, back_run_amount_usd,
  least(front_run_amount_usd, back_run_amount_usd) / greatest(front_run_amount_usd, back_run_amount_usd) AS similarity,
  profit_estimate_usd, count(*) AS victims,
  CAST(CAST(sum(CAST(CAST(victim_amount_usd AS VARCHAR) AS DECIMAL(36,18))) AS DECIMAL(38,18)) AS VARCHAR) AS victim_volume_usd
FROM sand GROUP BY ALL"""
_ONE_TRADER = f"""{SWAPS},
hot AS (SELECT * REPLACE ('0x' || repeat('9', 40) AS pool, '0x' || repeat('5', 40) AS sender) FROM swaps),
{_roundtrips(3600, "500", "hot")}"""
_CLEANED = f"""{RAW},
typed AS (SELECT * REPLACE (
    CAST(trunc(TRY_CAST(timestamp AS DOUBLE)) AS BIGINT) AS timestamp,
    lower(pool) AS pool, lower(sender) AS sender, lower(recipient) AS recipient)
  FROM raw WHERE TRY_CAST(timestamp AS DOUBLE) IS NOT NULL),
{_dedup("typed", "kept")}"""
_ATTACKER_TOTALS = """SELECT attacker, count(DISTINCT (pool, front_run_tx, back_run_tx)) AS pairs, count(*) AS victims,
  count(DISTINCT pool) AS pools,
  CAST(CAST(sum(CAST(CAST(victim_amount_usd AS VARCHAR) AS DECIMAL(36,18))) AS DECIMAL(38,18)) AS VARCHAR) AS victim_volume_usd,
  max(profit_estimate_usd) AS largest_profit_usd
FROM sand GROUP BY attacker"""
_ALL_FOUND = _with(FOUND, "SELECT * FROM sand")


def _summary(min_usd: str) -> str:
    return f"""SELECT count(*) AS total_candidates, (SELECT count(*) FROM swaps) AS total_swaps_analyzed,
  (SELECT count(DISTINCT pool) FROM swaps) AS pools_analyzed, CAST(21600 AS INTEGER) AS time_window_seconds,
  count(DISTINCT attacker) AS unique_attackers, count(*) FILTER (confidence_score >= 0.8) AS high_confidence_count,
  CASE WHEN (SELECT count(*) FROM swaps) = 0 THEN 'Empty DataFrame provided'
    WHEN (SELECT count(*) FROM swaps WHERE amount_usd >= {min_usd}) = 0
    THEN 'No transactions above minimum USD threshold' END AS status
FROM sand"""


def _error_rules(source: str, key: str, rules: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {bad} THEN '{message}' END" for bad, message in rules)
    return f"SELECT {key}, array_to_string([e FOR e IN [{parts}] IF e IS NOT NULL], '; ') AS quality_errors FROM {source}"


def _count_per(key: str, name: str) -> str:
    return _with(FOUND, f"SELECT {key} AS {name}, count(*) AS attacks FROM sand GROUP BY 1")


_DAY = "CAST(make_timestamp(victim_timestamp * 1000000) AS DATE)"
_HOUR = "CAST(victim_timestamp % 86400 // 3600 AS INTEGER)"

# Numbers of four shapes by block_number % 4: as written, and in canonical form.
_PLACES = "rtrim('.' || lpad(CAST({0} AS VARCHAR), 30, '0'), '0')"
_WIDE = f"""{SWAPS},
wide AS (
  SELECT *, CASE shape WHEN 0 THEN '-' || b || repeat('0', 35) || {_PLACES.format("b")} WHEN 1 THEN b || '.5'
      WHEN 2 THEN b || repeat('0', 40) ELSE '0' || {_PLACES.format("b")} END AS exact,
    CASE shape WHEN 0 THEN '-' || b || repeat('0', 35) || '.' || lpad(CAST(b AS VARCHAR), 30, '0') WHEN 1 THEN '+000' || b || '.500'
      WHEN 2 THEN b || 'e40' ELSE b || 'E-30' END AS written
  FROM (SELECT tx_hash, pool, block_number AS b, block_number % 4 AS shape FROM swaps WHERE block_number > 0))"""
_VALID_CLEANED = f"""{CHECKED},
typed_valid AS (SELECT * EXCLUDE (errors) REPLACE (
    CAST(timestamp AS BIGINT) AS timestamp, lower(pool) AS pool, lower(sender) AS sender, lower(recipient) AS recipient)
  FROM checked WHERE len(errors) = 0),
{_dedup("typed_valid", "kept_valid")}"""
_ROBUST = """SELECT tx_hash, round(CASE WHEN mad > 0 THEN (v - med) * 0.6745e0 / mad END, 6) AS robust_z
FROM (SELECT *, median(abs(v - med)) OVER (PARTITION BY pool) AS mad
  FROM (SELECT *, median(v) OVER (PARTITION BY pool) AS med FROM (SELECT *, CAST(amount_usd AS DOUBLE) AS v FROM {0})))"""
_LOOPS = f"""{SWAPS},
e AS (
  SELECT pool, '0x' || lpad(CAST(block_number % 10 AS VARCHAR), 40, '0') AS s, '0x' || lpad(CAST(block_number // 10 % 10 AS VARCHAR), 40, '0') AS r,
    timestamp AS ts, block_number AS b, tx_hash AS tx, CAST(amount_usd AS DECIMAL(38,2)) AS usd
  FROM swaps WHERE amount_usd >= 500 AND block_number % 10 <> block_number // 10 % 10),
p(pool, addrs, txs, tip, start, last, lb, lo, hi, vol, k) AS (
  SELECT pool, [s], [tx], r, ts, ts, b, usd, usd, usd, 1 FROM e
  UNION ALL
  SELECT p.pool, list_append(addrs, s), list_append(txs, tx), r, start, ts, b, least(lo, usd), greatest(hi, usd), vol + usd, k + 1
  FROM p JOIN e ON e.pool = p.pool AND e.s = p.tip AND (e.ts, e.b) > (p.last, p.lb) AND e.ts - p.start <= 43200
    AND CAST(least(lo, usd) AS DOUBLE) / CAST(greatest(hi, usd) AS DOUBLE) >= 0.6e0
    AND (e.r = addrs[1] OR NOT list_contains(addrs, e.r))
  WHERE p.tip <> addrs[1] AND k < 4)
"""


ORACLES: dict[str, str] = {
    # sources, sinks
    "scan_swaps": _with(SWAPS, f"SELECT {TEXT_COLUMNS} FROM swaps"),
    "scan_pool_time_range": _with(
        SWAPS,
        f"SELECT {TEXT_COLUMNS} FROM swaps WHERE pool = {_POOL} AND timestamp BETWEEN {RANGE_START} AND {RANGE_END}",
    ),
    "scan_lookback_hours": _with(
        SWAPS,
        f"SELECT {TEXT_COLUMNS} FROM swaps WHERE pool = {_POOL} "
        f"AND timestamp BETWEEN {RANGE_END} - 240 * 3600 AND {RANGE_END}",
    ),
    "scan_lookback_default": _with(
        SWAPS, f"SELECT {TEXT_COLUMNS} FROM swaps WHERE pool = {_POOL} AND timestamp BETWEEN {RANGE_END} - 24 * 3600 AND {RANGE_END}"
    ),
    "normalise_raw_swaps": _with(
        SWAPS,
        f"""SELECT * REPLACE (
  CASE WHEN block_number % 6 = 5 THEN NULL ELSE timestamp END AS timestamp,
  CASE WHEN block_number % 6 = 5 THEN NULL ELSE sender END AS sender)
FROM (SELECT {TEXT_COLUMNS} FROM swaps)""",
    ),
    "project_canonical": _with(
        SWAPS,
        f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS recipient, CAST(NULL AS INTEGER) AS tick)
FROM (SELECT {TEXT_COLUMNS} FROM swaps)""",
    ),
    "write_parquet": _with(SWAPS, f"SELECT {TEXT_COLUMNS} FROM swaps"),
    "typed_empty": _with(f"{SWAPS},\n{_sandwich(min_usd='1e15')}", "SELECT * FROM sand"),
    "empty_input_status": _with(f"{SWAPS},\n{_sandwich(min_usd='1e15')}", _summary("1e15")),
    "candidates_to_table": _with(
        PATTERNS,
        """SELECT 'roundtrip' AS detection_type, trader AS primary_address, trader AS involved_addresses, pool,
  CAST(NULL AS VARCHAR) AS token_pair, array_to_string(txs, ',') AS related_tx_hashes,
  first_timestamp AS start_timestamp, last_timestamp AS end_timestamp,
  CAST(roundtrip_count * 2 AS BIGINT) AS trade_count, CAST(1 AS BIGINT) AS unique_addresses,
  time_span_seconds AS time_window_seconds, roundtrip_count AS round_trip_count,
  round(CAST(time_span_seconds AS DOUBLE) / (roundtrip_count * 2 - 1), 6) AS avg_trade_interval_seconds,
  round(alike, 6) AS amount_similarity_score, CAST(total_volume_usd AS VARCHAR) AS volume_usd_total,
  CAST(NULL AS DOUBLE) AS counterparty_diversity, confidence_score,
  'Address made ' || roundtrip_count || ' roundtrip trades within ' || time_span_seconds || ' seconds' AS description
FROM patterns""",
    ),
    # cleaning, filters, derived columns
    "coerce_timestamp": _with(
        RAW,
        """SELECT CAST(trunc(TRY_CAST(timestamp AS DOUBLE)) AS BIGINT) AS timestamp, block_number, tx_hash
FROM raw WHERE TRY_CAST(timestamp AS DOUBLE) IS NOT NULL""",
    ),
    "lowercase_addresses": _with(
        RAW,
        """SELECT tx_hash, block_number, CASE WHEN pool <> '0xinvalid' THEN lower(pool) END AS pool,
  lower(sender) AS sender, lower(recipient) AS recipient FROM raw""",
    ),
    "backfill_columns": _with(
        RAW,
        f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS recipient, CAST(NULL AS VARCHAR) AS amount1) FROM (SELECT {COLUMNS} FROM raw)",
    ),
    "stringify_amounts": _with(
        SWAPS, "SELECT tx_hash, CAST(amount0 AS VARCHAR) AS amount0, CAST(amount1 AS VARCHAR) AS amount1 FROM swaps"
    ),
    "dedup_swaps": _with(f"{RAW},\n{_dedup('raw', 'kept')}", f"SELECT {COLUMNS} FROM kept"),
    "dedup_hot_copies": _with(_HOT_COPIES, f"SELECT {TEXT_COLUMNS} FROM kept"),
    "clean_swaps": _with(_CLEANED, f"SELECT {COLUMNS} FROM kept"),
    "filter_min_usd_clean": _with(
        RAW, "SELECT tx_hash, block_number, amount_usd FROM raw WHERE TRY_CAST(amount_usd AS DOUBLE) >= 12345"
    ),
    "filter_min_usd_detect": _with(
        RAW,
        "SELECT tx_hash, block_number, amount_usd FROM raw WHERE tick <> '7' AND TRY_CAST(amount_usd AS DOUBLE) >= 100",
    ),
    "filter_by_pool": _with(SWAPS, f"SELECT {TEXT_COLUMNS} FROM swaps WHERE pool = {_POOL}"),
    "filter_by_sender": _with(
        SWAPS, f"SELECT {TEXT_COLUMNS} FROM swaps WHERE sender = '0x' || repeat('0', 39) || '7'"
    ),
    "filter_by_value_range": _with(
        SWAPS,
        "SELECT tx_hash, CAST(amount_usd AS VARCHAR) AS amount_usd FROM swaps WHERE amount_usd BETWEEN 1000 AND 5000",
    ),
    "trade_direction": _with(
        RAW,
        """SELECT tx_hash, block_number, CASE
  WHEN TRY_CAST(amount0 AS DOUBLE) < 0 AND TRY_CAST(amount1 AS DOUBLE) > 0 THEN 'buy'
  WHEN TRY_CAST(amount0 AS DOUBLE) > 0 AND TRY_CAST(amount1 AS DOUBLE) < 0 THEN 'sell' ELSE 'neither' END AS direction
FROM raw""",
    ),
    "wash_direction": _with(
        SWAPS, "SELECT tx_hash, CASE WHEN amount0 < 0 THEN 'buy' ELSE 'sell' END AS direction FROM swaps"
    ),
    "swap_derived": _with(
        SWAPS,
        """SELECT tx_hash, CAST(CAST(amount_usd AS DECIMAL(38,18)) AS VARCHAR) AS usd_value,
  CAST(CAST(abs(amount0) AS DECIMAL(38,18)) AS VARCHAR) AS abs_amount0,
  CAST(CAST(abs(amount1) AS DECIMAL(38,18)) AS VARCHAR) AS abs_amount1 FROM swaps""",
    ),
    "filter_min_confidence": _with(FOUND, "SELECT * FROM sand WHERE confidence_score >= 0.6e0"),
    "filter_sure": _with(FOUND, "SELECT * FROM sand WHERE confidence_score >= 0.8e0"),
    "high_confidence": _with(FOUND, "SELECT * FROM sand WHERE confidence_score >= 0.7e0"),
    "cap_outliers_q99": _with(_CAPPED, "SELECT * FROM capped"),
    "epoch_to_timestamp": _with(SWAPS, "SELECT tx_hash, make_timestamp(timestamp * 1000000) AS ts_utc FROM swaps"),
    "short_address": _with(
        SWAPS, f"SELECT tx_hash, {_LABEL.format('tx_hash')} AS tx_label, {_SHORT.format('sender')} AS sender_label FROM swaps"
    ),
    "wash_candidate_derived": _with(
        PATTERNS,
        """SELECT pool, trader AS primary_address, time_span_seconds AS duration_seconds,
  round(CAST(total_volume_usd AS DOUBLE) / (roundtrip_count * 2), 6) AS avg_trade_size_usd,
  true AS is_single_address FROM patterns""",
    ),
    # data quality
    "validate_swaps": _with(
        CHECKED,
        "SELECT tx_hash, block_number, len(errors) = 0 AS is_valid, array_to_string(errors, '; ') AS quality_errors FROM checked",
    ),
    "validation_errors": _with(
        CHECKED, "SELECT tx_hash, block_number, errors[1] AS error FROM checked WHERE len(errors) > 0"
    ),
    "validation_summary": _with(
        CHECKED,
        """SELECT count(*) AS total_records, count(*) FILTER (len(errors) = 0) AS valid_records,
  count(*) FILTER (len(errors) > 0) AS invalid_records,
  round(CAST(count(*) FILTER (len(errors) = 0) AS DOUBLE) / count(*) * 100, 6) AS success_rate,
  count(*) FILTER (len(errors) > 0) = 0 AS is_valid FROM checked""",
    ),
    "duplicate_count": _with(
        RAW,
        """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM (
  SELECT count(*) AS n FROM raw GROUP BY tx_hash, timestamp, sender, recipient)""",
    ),
    "check_schema": _with(
        RAW,
        """SELECT finding, "column", (SELECT count(*) FROM raw) AS affected_rows
FROM (VALUES ('missing', 'sqrtPriceX96'), ('missing', 'tick'), ('unexpected', 'sqrt_price')) f(finding, "column")""",
    ),
    "amount_consistency": _with(
        RAW,
        """SELECT tx_hash, block_number, coalesce(
  sign(TRY_CAST(amount0 AS DOUBLE)) * sign(TRY_CAST(amount1 AS DOUBLE)) < 0, false) AS consistent FROM raw""",
    ),
    "usd_value_valid": _with(
        RAW,
        "SELECT tx_hash, block_number, coalesce(TRY_CAST(amount_usd AS DECIMAL(38,18)) > 1000, false) AS usd_valid FROM raw",
    ),
    "validate_sandwich_candidates": _with(
        f"{FOUND},\nd AS (SELECT *, front_run_timestamp % 9 AS k FROM sand)",
        _error_rules(
            "(SELECT * REPLACE (CASE WHEN k = 3 THEN '0x12' ELSE victim_tx END AS victim_tx) FROM d)",
            "front_run_tx, victim_tx, back_run_tx, front_run_timestamp, victim_timestamp",
            [
                ("k = 0", "attacker: not an address"),
                ("k = 3", "victim_tx: not a transaction hash"),
                ("k = 6", "confidence_score: not in 0..1"),
            ],
        ),
    ),
    "validate_wash_candidates": _with(
        f"{WASH},\nd AS (SELECT *, first_timestamp % 9 AS k FROM wash)",
        _error_rules(
            "d",
            "pool, first_tx, last_tx",
            [
                ("k = 0", "trader: not an address"),
                ("k = 3", "roundtrip_count: below 3"),
                ("k = 6", "avg_roundtrip_time: negative"),
            ],
        ),
    ),
    "validate_wash_patterns": _with(
        f"{PATTERNS},\nd AS (SELECT *, trader AS primary_address, first_timestamp % 9 AS k FROM patterns)",
        _error_rules(
            "d",
            "pool, primary_address",
            [
                ("k = 0", "detection_type: unknown"),
                ("k = 3", "related_tx_hashes: fewer than 2 or not all transaction hashes"),
                ("k = 6", "end_timestamp: before start"),
                ("k = 7", "description: not 10..2000 characters"),
            ],
        ),
    ),
    "quarantine": _with(
        CHECKED,
        """SELECT tx_hash, block_number, timestamp,
  CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'quarantined' END AS part FROM checked""",
    ),
    # sandwich detection
    "sandwich_candidates_all": _ALL_FOUND,
    "sandwich_candidates_split": _ALL_FOUND,
    "concat_pools": _ALL_FOUND,
    "sandwich_attacks_all": _with(FOUND, _ATTACKS),
    "sandwich_attacks_hot_pool": _with(_HOT_DAY, _ATTACKS),
    "attacker_totals": _with(FOUND, _ATTACKER_TOTALS),
    "sandwich_hot_pool": _with(_HOT_POOL, "SELECT * FROM sand"),
    "reversal_pairs_all": _with(
        FOUND,
        """SELECT pool, sender AS attacker, ftx AS front_run_tx, btx AS back_run_tx, fts AS front_run_timestamp,
  bts AS back_run_timestamp, fusd AS front_run_amount_usd, busd AS back_run_amount_usd, alike AS similarity
FROM sand_pairs""",
    ),
    "sandwich_equi_pairs": _with(
        f"{SWAPS},\n{_sandwich(similarity='0e0')}",
        "SELECT pool, sender AS attacker, ftx AS front_run_tx, btx AS back_run_tx FROM sand_pairs",
    ),
    "sandwich_interval": _with(f"{SWAPS},\n{_sandwich(3600)}", "SELECT * FROM sand"),
    "sandwich_confidence": _with(
        f"{SWAPS},\ng AS (SELECT tx_hash, block_number % 120 AS span, CAST(amount_usd AS DOUBLE) AS usd, "
        "CAST(amount_usd AS DOUBLE) * CAST(tick % 10 + 1 AS DOUBLE) / 10e0 AS front, "
        "CAST(block_number % 101 AS DOUBLE) / 100e0 AS alike FROM swaps)",
        f"SELECT tx_hash, {_sandwich_score('span', 'alike', 'usd', 'front')} AS confidence_score FROM g",
    ),
    "amount_similarity": _with(
        SWAPS,
        """SELECT tx_hash, least(CAST(amount_usd AS DOUBLE), 5000e0) / greatest(CAST(amount_usd AS DOUBLE), 5000e0)
  AS similarity FROM swaps""",
    ),
    "profit_estimate": _with(
        SWAPS, "SELECT tx_hash, greatest(CAST(amount_usd AS DOUBLE) - 5000e0, 0e0) AS profit FROM swaps"
    ),
    # wash detection
    "pool_time_order": _with(SWAPS, "SELECT pool, timestamp, tx_hash FROM swaps ORDER BY pool, timestamp, block_number"),
    "consecutive_pairs_all": _with(f"{WASH_SWAPS},\n{_roundtrips()}", f"SELECT {_LEGS} FROM placed"),
    "roundtrips_all": _with(f"{WASH_SWAPS},\n{_roundtrips()}", f"SELECT {_LEGS} FROM rt"),
    "roundtrips_many_chunks": _with(f"{WASH_SWAPS},\n{_roundtrips()}", f"SELECT {_LEGS} FROM rt"),
    "roundtrips_one_trader": _with(_ONE_TRADER, f"SELECT {_LEGS} FROM rt"),
    "wash_trades_all": _with(WASH, f"SELECT {_WASH_OUT} FROM wash"),
    "wash_trades_no_price": _with(_wash(price=False), f"SELECT {_WASH_OUT} FROM wash"),
    "wash_first_last": _with(
        WASH, "SELECT pool, trader, first_tx, last_tx, first_timestamp, last_timestamp FROM wash"
    ),
    "wash_confidence": _with(
        f"{SWAPS},\ng AS (SELECT tx_hash, block_number % 15 + 1 AS n, CAST(block_number % 300 AS DOUBLE) AS gap, "
        "CASE WHEN tick % 7 <> 0 THEN CAST(tick % 130 AS DOUBLE) / 1000e0 END AS spread FROM swaps)",
        f"SELECT tx_hash, {_wash_score('n', 'spread', 'gap', 300)} AS confidence_score FROM g",
    ),
    "sqrt_price_to_price": _with(
        SWAPS,
        """SELECT tx_hash, (CAST("sqrtPriceX96" AS DOUBLE) / 79228162514264337593543950336e0)
  * (CAST("sqrtPriceX96" AS DOUBLE) / 79228162514264337593543950336e0) AS price FROM swaps""",
    ),
    "price_dispersion": _with(
        f"{SWAPS},\ng AS (SELECT pool, sender, abs(CAST(amount0 AS DOUBLE)) AS r, CASE WHEN tick % 2 = 0 THEN "
        "(CAST(\"sqrtPriceX96\" AS DOUBLE) / 79228162514264337593543950336e0) ** 2 END AS p FROM swaps)",
        """SELECT pool, sender, round(CASE WHEN count(p) > 0 THEN stddev_samp(p) / avg(p)
  WHEN count(r) > 0 THEN CASE WHEN avg(r) <> 0 THEN stddev_samp(r) / avg(r) END ELSE 0.1e0 END, 6) AS dispersion
FROM g GROUP BY pool, sender""",
    ),
    "wash_total_volume": _with(
        WASH, "SELECT pool, trader, CAST(total_volume_usd AS VARCHAR) AS total_volume_usd FROM wash"
    ),
    "wash_avg_time": _with(
        WASH, "SELECT pool, trader, round(avg_roundtrip_time, 6) AS avg_roundtrip_time FROM wash"
    ),
    # profiles
    "run_counters": _with(
        SWAPS,
        """SELECT count(*) AS total_swaps_analyzed,
  count(DISTINCT CASE WHEN tick % 10 <> 0 THEN pool END) AS pools_analyzed FROM swaps""",
    ),
    "sandwich_summary": _with(FOUND, _summary("1000")),
    "sandwich_by_pool": _with(
        FOUND,
        f"""SELECT pool, count(*) AS candidates, round({_MEAN_SCORE}, 6) AS avg_confidence,
  CAST({_PROFIT} AS VARCHAR) AS total_profit_usd FROM sand GROUP BY pool""",
    ),
    "pools_by_count": _with(FOUND, "SELECT pool, count(*) AS candidates FROM sand GROUP BY pool"),
    "wash_report_stats": _with(
        WASH,
        f"""SELECT count(*) AS candidates, CAST(CAST(coalesce(sum(CAST(total_volume_usd AS DECIMAL(36,18))), 0)
    AS DECIMAL(38,18)) AS VARCHAR) AS total_volume_usd,
  round({_MEAN_SCORE}, 6) AS avg_confidence, round(avg(roundtrip_count), 6) AS avg_roundtrips
FROM wash WHERE confidence_score >= 0.6e0""",
    ),
    "attacker_profile": _with(
        FOUND,
        f"""SELECT attacker, count(victim_tx) AS attack_count, CAST({_PROFIT} AS VARCHAR) AS total_profit_usd,
  round({_MEAN_SCORE}, 6) AS avg_confidence FROM sand GROUP BY attacker""",
    ),
    "hourly_timeline": _count_per("date_trunc('hour', make_timestamp(victim_timestamp * 1000000))", "hour"),
    "hour_of_day": _count_per(_HOUR, "hour_of_day"),
    "daily_counts": _count_per(_DAY, "day"),
    "peak_hour_day": _with(
        f"""{FOUND},
h AS (SELECT {_HOUR} AS k, count(*) AS n FROM sand GROUP BY 1 ORDER BY n DESC, k LIMIT 1),
d AS (SELECT {_DAY} AS k, count(*) AS n FROM sand GROUP BY 1 ORDER BY n DESC, k LIMIT 1)""",
        "SELECT h.k AS peak_hour, h.n AS peak_hour_attacks, d.k AS peak_day, d.n AS peak_day_attacks FROM h, d",
    ),
    "profit_stats": _with(
        FOUND,
        f"""SELECT CAST({_PROFIT} AS VARCHAR) AS total_profit_usd,
  round(CAST({_PROFIT} AS DOUBLE) / count(*), 6) AS mean_profit,
  round(median(profit_estimate_usd), 6) AS median_profit, round(max(profit_estimate_usd), 6) AS max_profit,
  round(min(profit_estimate_usd), 6) AS min_profit FROM sand""",
    ),
    "profit_q99": _with(
        FOUND,
        "SELECT count(*) AS candidates, round(quantile_cont(profit_estimate_usd, 0.99), 6) AS profit_q99 FROM sand",
    ),
    "percentile_brackets": _with(
        f"{SWAPS},\nu AS (SELECT CAST(amount_usd AS DOUBLE) AS usd FROM swaps)",
        """SELECT count(usd) AS n, round(quantile_cont(usd, 0.25), 6) AS q25,
  round(quantile_cont(usd, 0.5), 6) AS q50, round(quantile_cont(usd, 0.99), 6) AS q99 FROM u""",
    ),
    "confidence_profit_corr": _with(
        FOUND, "SELECT round(corr(confidence_score, profit_estimate_usd), 6) AS correlation FROM sand"
    ),
    "histogram_50": f"WITH {FOUND},\n{_histogram('sand', 'confidence_score')}",
    "histogram_50_profit": f"WITH {_CAPPED},\n{_histogram('capped', 'profit_estimate_usd')}",
    "confidence_ecdf": _with(
        FOUND,
        """SELECT confidence_score, count(*) AS n, round(CAST((
    SELECT count(*) FROM sand o WHERE o.confidence_score <= s.confidence_score) AS DOUBLE)
  / (SELECT count(*) FROM sand) * 100, 6) AS cumulative_percent FROM sand s GROUP BY confidence_score""",
    ),
    "box_stats": _with(
        f"""{FOUND},
q AS (SELECT quantile_cont(profit_estimate_usd, 0.25) AS q1, quantile_cont(profit_estimate_usd, 0.5) AS m,
  quantile_cont(profit_estimate_usd, 0.75) AS q3 FROM sand),
r AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)""",
        """SELECT round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(profit_estimate_usd) FILTER (profit_estimate_usd >= lo), 6) AS whisker_low,
  round(max(profit_estimate_usd) FILTER (profit_estimate_usd <= hi), 6) AS whisker_high,
  count(*) FILTER (profit_estimate_usd < lo OR profit_estimate_usd > hi) AS outliers FROM sand, r""",
    ),
    "detection_metrics": _with(
        FOUND,
        f"""SELECT (SELECT count(*) FROM swaps) AS total_swaps, count(*) AS total_candidates,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM swaps) * 100, 6) AS detection_rate_percent,
  count(DISTINCT attacker) AS unique_attackers, count(*) FILTER (confidence_score >= 0.7e0) AS high_confidence,
  round(CAST(count(*) FILTER (confidence_score >= 0.7e0) AS DOUBLE) / count(*) * 100, 6) AS high_confidence_percent,
  CAST({_PROFIT} AS VARCHAR) AS total_profit_usd FROM sand""",
    ),
    "numeric_summary": _with(
        SWAPS,
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(avg({c}), 6) AS mean, count(*) AS total_rows FROM swaps"""
            for c in ("timestamp", "block_number", "tick")
        ),
    ),
    "swap_set_stats": _with(
        SWAPS,
        """SELECT count(*) AS total_count, count(DISTINCT pool) AS unique_pools, count(DISTINCT sender) AS unique_senders,
  count(DISTINCT recipient) AS unique_recipients, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
  min(block_number) AS first_block, max(block_number) AS last_block FROM swaps""",
    ),
    "wash_pattern_rollup": _with(
        PATTERNS,
        """SELECT count(*) AS total_candidates, count(*) FILTER (confidence_score >= 0.8e0) AS high_confidence_count,
  count(DISTINCT trader) AS unique_addresses_involved, count(DISTINCT pool) AS pools_with_wash_trading,
  CAST(CAST(sum(CAST(total_volume_usd AS DECIMAL(36,18))) AS DECIMAL(38,18)) AS VARCHAR) AS total_volume_usd,
  count(*) FILTER (first_timestamp % 3 <> 0) AS roundtrip_count,
  count(*) FILTER (first_timestamp % 3 = 0) AS closed_loop_count FROM patterns""",
    ),
    # ranked reports
    "wash_sorted": _with(
        WASH, "SELECT trader, pool, confidence_score FROM wash ORDER BY confidence_score DESC, pool, trader"
    ),
    "top20_sandwiches": _with(
        FOUND,
        f"""SELECT CAST(row_number() OVER (ORDER BY confidence_score DESC, pool, front_run_timestamp, front_run_tx,
    victim_tx, back_run_tx) AS INTEGER) AS rank, {_LABEL.format("attacker")} AS attacker, {_LABEL.format("pool")} AS pool,
  confidence_score, profit_estimate_usd, {_LABEL.format("victim_tx")} AS victim, front_run_tx, victim_tx, back_run_tx
FROM sand ORDER BY rank LIMIT 20""",
    ),
    "top10_wash": _with(
        WASH,
        f"""SELECT CAST(row_number() OVER (ORDER BY confidence_score DESC, pool, trader) AS INTEGER) AS rank,
  {_SHORT.format("trader")} AS trader_label, {_SHORT.format("pool")} AS pool_label, trader, pool, roundtrip_count,
  CAST(total_volume_usd AS VARCHAR) AS total_volume_usd, round(avg_roundtrip_time, 6) AS avg_roundtrip_time,
  confidence_score FROM wash WHERE confidence_score >= 0.5e0 ORDER BY rank LIMIT 10""",
    ),
    "top10_attackers": _with(
        FOUND,
        f"""SELECT attacker, attack_count, CAST(p AS VARCHAR) AS total_profit_usd, avg_confidence FROM (
  SELECT attacker, count(victim_tx) AS attack_count, {_PROFIT} AS p, round({_MEAN_SCORE}, 6) AS avg_confidence
  FROM sand GROUP BY attacker ORDER BY p DESC, attacker LIMIT 10)""",
    ),
    "top5_cases": _with(
        FOUND,
        """SELECT attacker, victim_tx, make_timestamp(victim_timestamp * 1000000) AS victim_time, confidence_score,
  profit_estimate_usd, front_run_tx, back_run_tx FROM sand WHERE confidence_score >= 0.6e0
ORDER BY profit_estimate_usd DESC, front_run_tx, victim_tx, back_run_tx LIMIT 5""",
    ),
    "top5_sure_cases": _with(
        FOUND,
        """SELECT attacker, victim_tx, make_timestamp(victim_timestamp * 1000000) AS victim_time, confidence_score,
  profit_estimate_usd, front_run_tx, back_run_tx FROM sand WHERE confidence_score >= 0.8e0
ORDER BY profit_estimate_usd DESC, front_run_tx, victim_tx, back_run_tx LIMIT 5""",
    ),
    "error_sample": _with(
        CHECKED,
        """SELECT tx_hash, block_number, errors[1] AS error FROM checked WHERE len(errors) > 0
ORDER BY tx_hash, block_number, error LIMIT 10""",
    ),
    # set operations
    "distinct_attackers": _with(FOUND, "SELECT DISTINCT attacker, pool FROM sand"),
    # exact numbers of any length
    "wide_values": _with(
        _WIDE,
        "SELECT tx_hash, exact AS usd_exact, ltrim(exact, '-') AS abs_amount0_exact, ltrim(exact, '-') AS abs_amount1_exact FROM wide",
    ),
    "wide_value_range": _with(
        _WIDE, "SELECT tx_hash, written AS amount_usd FROM wide WHERE shape = 1 OR (shape = 2 AND b <= 5000) OR (shape = 3 AND b >= 50)"
    ),
    "wide_sums_by_pool": _with(
        _WIDE,
        f"""SELECT pool, shape = 0 AS negative, CASE WHEN shape = 0 THEN '-' || n0 || repeat('0', 35) || {_PLACES.format("n0")}
  ELSE CASE WHEN n2 > 0 THEN n2 || repeat('0', 40) ELSE '0' END || CASE WHEN n3 > 0 THEN {_PLACES.format("n3")} ELSE '' END END AS total
FROM (SELECT pool, CASE WHEN shape = 0 THEN 0 ELSE 2 END AS shape, CAST(coalesce(sum(b) FILTER (shape = 0), 0) AS BIGINT) AS n0,
    CAST(coalesce(sum(b) FILTER (shape = 2), 0) AS BIGINT) AS n2, CAST(coalesce(sum(b) FILTER (shape = 3), 0) AS BIGINT) AS n3
  FROM wide WHERE shape <> 1 GROUP BY ALL)""",
    ),
    # cleaning in one pass
    "cleaning_report": _with(
        _CLEANED,
        """SELECT 'rows' AS section, unnest(['total', 'valid', 'invalid', 'duplicates', 'removed']) AS name,
  unnest([n, 0, n, n - d, n - k]) :: DOUBLE AS value
FROM (SELECT count(*) AS n, count(DISTINCT (tx_hash, timestamp, sender)) AS d, (SELECT count(*) FROM kept) AS k FROM raw)
UNION ALL SELECT 'missing', 'recipient', 1
"""
        + "\n".join(
            f"""UNION ALL SELECT '{name}', unnest(['n', 'min', 'max', 'mean']), unnest([count(x), min(x), max(x), round(avg(x), 4)])
FROM (SELECT TRY_CAST({name} AS DOUBLE) AS x FROM raw)"""
            for name in ("timestamp", "block_number", "amount0", "amount1", "amount_usd", "tick")
        ),
    ),
    "cleaned_by_job": _with(
        _VALID_CLEANED,
        f"""SELECT * REPLACE (CAST(block_number AS BIGINT) AS block_number, CAST(tick AS INTEGER) AS tick)
FROM (SELECT {COLUMNS} FROM kept_valid WHERE CAST(amount_usd AS DOUBLE) >= 5000)""",
    ),
    "strict_cleaning": _with(
        f"{_CLEANED},\n{_VALID_CLEANED.removeprefix(RAW + ',')}",
        "SELECT 'raw' AS input, true AS raised, (SELECT count(*) FROM kept) AS written UNION ALL SELECT 'valid', false, (SELECT count(*) FROM kept_valid)",
    ),
    "required_columns": _with(
        SWAPS,
        """SELECT unnest(['sandwich', 'sandwich', 'wash', 'wash']) AS job, unnest(['amount_usd', 'sender', 'amount_usd', 'sender']) AS missing,
  count(*) AS rows FROM swaps""",
    ),
    "text_order_keys": _with(
        f"""{SWAPS},
shared AS (SELECT * REPLACE (timestamp // 21600 * 21600 AS timestamp) FROM swaps),
{_sandwich(source="shared")}""",
        "SELECT * FROM sand",
    ),
    "dedup_by_number": _with(SWAPS, "SELECT tx_hash, '9' || lpad(CAST(block_number AS VARCHAR), 7, '0') AS block_number FROM swaps"),
    # statistics per pool, several addresses
    "robust_z_all": _with(SWAPS, _ROBUST.format("swaps")),
    "robust_z_hot_pool": _with(
        f"""{SWAPS},
hot AS (SELECT * REPLACE (
    CASE WHEN block_number % 3 = 0 THEN '0x' || repeat('9', 40) ELSE pool END AS pool,
    CASE WHEN block_number % 5 = 0 THEN CAST(5000 AS DECIMAL(20,2)) ELSE amount_usd END AS amount_usd) FROM swaps)""",
        _ROBUST.format("hot"),
    ),
    "closed_loops": "WITH RECURSIVE "
    + _LOOPS
    + """SELECT pool, array_to_string(addrs, '; ') AS addresses, array_to_string(txs, '; ') AS txs, start AS first_timestamp, last AS last_timestamp,
  CAST(CAST(vol AS DECIMAL(38,18)) AS VARCHAR) AS volume FROM p WHERE tip = addrs[1]""",
    "closed_loops_split": "WITH RECURSIVE " + _LOOPS + "SELECT pool, array_to_string(txs, '; ') AS txs FROM p WHERE tip = addrs[1]",
    "closed_loop_patterns": "WITH RECURSIVE "
    + _LOOPS
    + """SELECT 'closed_loop' AS detection_type, CAST(k AS BIGINT) AS trade_count, CAST(k AS BIGINT) AS unique_addresses, count(*) AS n,
  CAST(0 AS BIGINT) AS n_broken FROM p WHERE tip = addrs[1] GROUP BY k""",
    "coordinated_groups": f"""WITH RECURSIVE {SWAPS},
present AS (
  SELECT DISTINCT pool, amount0 < 0 AS buy, timestamp // 3600 AS bucket, length(bin(CAST(floor(amount_usd) AS BIGINT))) AS size, sender
  FROM swaps WHERE amount_usd >= 500 AND ((amount0 < 0 AND amount1 > 0) OR (amount0 > 0 AND amount1 < 0))),
pairs AS (SELECT pool, sender AS one, lead(sender) OVER (PARTITION BY pool, buy, bucket, size ORDER BY sender) AS other FROM present),
edges AS (SELECT pool, one, other, count(*) AS n FROM pairs WHERE other IS NOT NULL GROUP BY ALL HAVING count(*) >= 4),
twice AS (SELECT pool, one AS u, other AS v FROM edges UNION SELECT pool, other, one FROM edges),
reach AS (SELECT DISTINCT pool, u, u AS w FROM twice UNION SELECT r.pool, r.u, b.v FROM reach r JOIN twice b ON b.pool = r.pool AND b.u = r.w),
label AS (SELECT pool, u AS address, min(w) AS group_id FROM reach GROUP BY pool, u)
SELECT l.*, count(*) OVER (PARTITION BY l.pool, l.group_id) AS group_size, CAST(m.meetings AS BIGINT) AS meetings
FROM label l JOIN (SELECT e.pool, group_id, sum(n) AS meetings FROM edges e JOIN label x ON x.pool = e.pool AND x.address = e.one GROUP BY ALL) m
  ON m.pool = l.pool AND m.group_id = l.group_id""",
}
