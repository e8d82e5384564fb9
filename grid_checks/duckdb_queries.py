"""The same queries in DuckDB SQL, written against the sample tables alone."""

from __future__ import annotations

from attempt_grid.operators.contract import ATTEMPT_COLUMNS
from grid_checks.sample_tables import MONTHS

ORACLE: dict[str, str] = {}

# --- inputs ------------------------------------------------------------------

_EVENTS = """
ev AS (
  SELECT user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""

_SEGMENT = """CASE event_type WHEN 'click' THEN 'far_win' WHEN 'purchase' THEN 'close_win'
    WHEN 'view' THEN 'close_fail' WHEN 'error' THEN 'far_fail' ELSE 'unknown' END"""

_EVENT_ATTEMPTS = f"""{_EVENTS},
attempts AS (
  SELECT ts AS client_time, CAST(user_id AS VARCHAR) AS user_id, k AS balance_id,
    c_mktsegment AS traffic_type,
    CASE WHEN c_acctbal > 5000 THEN 'payer' ELSE 'nonpayer' END AS payer_type,
    CAST(event_type IN ('view', 'error') AS INTEGER) AS failed,
    1 + k % 3 AS attempt,
    CASE WHEN k % 2 = 0 THEN 'ios' ELSE 'android' END AS platform_name,
    CAST(k % 3 = 0 AS INTEGER) AS first_attempt,
    CAST(event_type = 'click' AS INTEGER) AS "FW",
    CAST(event_type = 'purchase' AS INTEGER) AS "CW",
    CAST(event_type = 'view' AS INTEGER) AS "CF",
    CAST(event_type = 'error' AS INTEGER) AS "FF",
    {_SEGMENT} AS reason_seg,
    CAST(ts AS DATE) AS partition_date,
    CAST(floor(k / 10.0) AS INTEGER) AS level_cohort,
    value > 50 AS super_ball
  FROM ev JOIN customer ON user_id = c_custkey
)"""

_LINEITEM_ATTEMPTS = """
attempts AS (
  SELECT l_shipdate AS client_time, CAST(o_custkey AS VARCHAR) AS user_id,
    CAST(l_partkey AS INTEGER) AS balance_id,
    o_orderpriority AS traffic_type,
    CASE WHEN c_acctbal > 5000 THEN 'payer' ELSE 'nonpayer' END AS payer_type,
    CAST(l_returnflag = 'R' AS INTEGER) AS failed,
    l_linenumber AS attempt,
    o_orderstatus AS platform_name,
    CAST(l_linenumber = 1 AS INTEGER) AS first_attempt,
    CAST(l_returnflag = 'A' AND l_linestatus = 'F' AS INTEGER) AS "FW",
    CAST(l_returnflag = 'A' AND l_linestatus = 'O' AS INTEGER) AS "CW",
    CAST(l_returnflag = 'R' AND l_linestatus = 'O' AS INTEGER) AS "CF",
    CAST(l_returnflag = 'R' AND l_linestatus = 'F' AS INTEGER) AS "FF",
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'far_win' WHEN 'AO' THEN 'close_win'
      WHEN 'RO' THEN 'close_fail' WHEN 'RF' THEN 'far_fail' ELSE 'unknown' END AS reason_seg,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS partition_date,
    CAST(floor(l_partkey / 100.0) AS INTEGER) AS level_cohort,
    l_discount > 0.05 AS super_ball
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

_ATTEMPT_COLUMNS = """client_time, user_id, balance_id, traffic_type, payer_type, failed, attempt,
  platform_name, first_attempt, "FW", "CW", "CF", "FF", reason_seg, partition_date, level_cohort,
  super_ball"""

# Raw level events. chain_a is the column for unchained input, chain_b for chained input.
_LEVELS = f"""{_EVENTS},
levels AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts AS client_time,
    CASE WHEN value >= 1 THEN ts - to_hours(k) END AS event_time,
    CAST(ts AS DATE) AS partition_date,
    CASE WHEN k >= 95 THEN 'm3.level_started' ELSE 'm3.level_finished' END AS event_type,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'completed'
      WHEN event_type = 'signup' THEN 'aborted' ELSE 'failed' END AS reason,
    CASE WHEN value > 150 THEN 'WL_1' WHEN value > 120 THEN 'WLX1' WHEN value > 100 THEN 'main'
      END AS chain_a,
    CASE WHEN value > 150 THEN 'WL_1' WHEN value > 120 THEN 'WLX1' WHEN value > 100 THEN NULL
      ELSE 'main' END AS chain_b,
    CASE WHEN value > 60 THEN 'payer' ELSE 'nonpayer' END AS payer_type,
    CASE event_type
      WHEN 'click' THEN '["grp_' || (k % 7) || '","base"]'
      WHEN 'view' THEN '{{"obj_' || (k % 5) || '":1,"base":2}}'
      WHEN 'purchase' THEN '' WHEN 'error' THEN 'broken' END AS ab_group,
    CASE WHEN k = 50 THEN 'abc' WHEN k = 52 THEN '1.0' WHEN k = 53 THEN '1e0' WHEN k = 54 THEN '2.9'
      WHEN k <> 51 THEN CAST(1 + k % 3 AS VARCHAR) END AS attempt,
    CASE WHEN k = 13 THEN 'x' WHEN k <> 14 THEN 'st' || lpad(CAST(k * 10 AS VARCHAR), 5, '0')
      END AS level_id,
    CASE WHEN k NOT IN (13, 14) THEN k * 10 END AS balance_id,
    CASE WHEN NOT (event_type = 'error' AND value < 50) THEN {_SEGMENT} END AS reason_seg,
    CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS super_ball,
    CASE WHEN k = 7 THEN NULL WHEN k % 2 = 0 THEN 'ios' ELSE 'android' END AS platform_name
  FROM ev
)"""

_PLAYERS = """
players AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, t.traffic_type,
    CASE WHEN c_acctbal > 8000 THEN 'Cheater' WHEN c_acctbal > 4000 THEN 'Soft'
      ELSE 'Fair' END AS cheater
  FROM customer, LATERAL (
    SELECT c_mktsegment AS traffic_type
    UNION ALL SELECT CASE WHEN c_acctbal < 0 THEN 'crosspromo' ELSE c_mktsegment END) t
),
eligible AS (
  SELECT DISTINCT user_id, traffic_type FROM players WHERE cheater IN ('Fair', 'Soft')
)"""

_OUTCOMES = """
outcomes AS (
  SELECT ts AS client_time, CASE WHEN k NOT IN (13, 14) THEN k * 10 END AS balance_id,
    CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS partition_date,
    CASE WHEN event_type = 'click' THEN 1 END AS "FW",
    CASE WHEN event_type = 'purchase' THEN 1 END AS "CW",
    CASE WHEN event_type = 'view' THEN 1 END AS "CF",
    CASE WHEN event_type = 'error' THEN 1 END AS "FF"
  FROM ev, LATERAL (SELECT 1 AS copy UNION ALL SELECT 2 WHERE value > 90) c
  WHERE event_type <> 'error' OR k < 50
)"""

_MART_A = f"""{_LEVELS}, {_PLAYERS},
mart AS (
  SELECT client_time, balance_id, user_id, partition_date, traffic_type, payer_type,
    CASE WHEN reason = 'failed' THEN 1 ELSE 0 END AS failed,
    coalesce(reason_seg, 'unknown') AS reason_seg, attempt, super_ball, platform_name,
    CASE WHEN attempt IN ('1', '1.0', '1e0') THEN 1 ELSE 0 END AS first_attempt,
    CAST(floor(balance_id / 100.0) AS INTEGER) AS level_cohort,
    CASE WHEN reason_seg = 'far_win' THEN 1 ELSE 0 END AS "FW",
    CASE WHEN reason_seg = 'close_win' THEN 1 ELSE 0 END AS "CW",
    CASE WHEN reason_seg = 'close_fail' THEN 1 ELSE 0 END AS "CF",
    CASE WHEN reason_seg = 'far_fail' THEN 1 ELSE 0 END AS "FF"
  FROM levels JOIN eligible USING (user_id)
  WHERE event_type = 'm3.level_finished' AND reason IN ('completed', 'failed')
    AND chain_a IS NULL AND client_time > TIMESTAMP '2024-01-05 00:00:00'
    AND partition_date > DATE '2024-01-05'
)"""

_SEGMENT_OF_FLAGS = """CASE WHEN "FW" = 1 THEN 'far_win' WHEN "CW" = 1 THEN 'close_win'
    WHEN "CF" = 1 THEN 'close_fail' WHEN "FF" = 1 THEN 'far_fail' ELSE 'unknown' END"""

_MART_B = f"""{_LEVELS}, {_PLAYERS}, {_OUTCOMES},
flagged AS (
  SELECT l.client_time, l.balance_id, l.user_id, l.partition_date, e.traffic_type, l.payer_type,
    CASE WHEN reason = 'failed' THEN 1 ELSE 0 END AS failed, ab_group,
    CAST(trunc(TRY_CAST(attempt AS DOUBLE)) AS INTEGER) AS attempt, platform_name, super_ball,
    CASE WHEN attempt IN ('1', '1.0', '1e0') THEN 1 ELSE 0 END AS first_attempt,
    coalesce(o."FW", 0) AS "FW", coalesce(o."CW", 0) AS "CW",
    coalesce(o."CF", 0) AS "CF", coalesce(o."FF", 0) AS "FF",
    CAST(floor(l.balance_id / 100.0) AS INTEGER) AS level_cohort
  FROM levels l JOIN eligible e ON l.user_id = e.user_id
  LEFT JOIN outcomes o ON l.client_time = o.client_time AND l.balance_id = o.balance_id
    AND l.user_id = o.user_id AND l.partition_date = o.partition_date
  WHERE event_time IS NOT NULL AND epoch_ms(l.client_time) // 1000 - epoch_ms(event_time) // 1000 <= 259200
    AND event_type = 'm3.level_finished' AND reason IN ('completed', 'failed')
    AND chain_b NOT LIKE 'WL_%' AND l.client_time > TIMESTAMP '2024-01-05 00:00:00'
    AND l.partition_date > DATE '2024-01-05'
),
mart AS (SELECT *, {_SEGMENT_OF_FLAGS} AS reason_seg FROM flagged)"""


# --- statistics --------------------------------------------------------------


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN {part} / {whole} * 100 ELSE 0.0 END"


def _stats(condition: str = "TRUE") -> str:
    """CTE chain ending in ``stats`` over the ``attempts`` CTE."""
    total, wins, fails = "attempts_absolute", "wins_absolute", "fails_absolute"
    fail_rate = _pct("failed_absolute", total)
    return f"""
grouped AS (
  SELECT level_cohort AS level_group, partition_date AS date,
    CAST(sum("FW") AS DOUBLE) AS "FW_absolute", CAST(sum("CW") AS DOUBLE) AS "CW_absolute",
    CAST(sum("CF") AS DOUBLE) AS "CF_absolute", CAST(sum("FF") AS DOUBLE) AS "FF_absolute",
    CAST(sum("FW") + sum("CW") AS DOUBLE) AS wins_absolute,
    CAST(sum("FF") + sum("CF") AS DOUBLE) AS fails_absolute,
    CAST(count(*) AS DOUBLE) AS attempts_absolute,
    CAST(sum(failed) AS DOUBLE) AS failed_absolute,
    CAST(avg(attempt) AS DOUBLE) AS attempt_average,
    CAST(sum(first_attempt) AS DOUBLE) AS first_attempt_absolute
  FROM attempts WHERE {condition} GROUP BY ALL
),
stats AS (
  SELECT *,
    {_pct('"FW_absolute"', total)} AS "FW_relative",
    {_pct('"CW_absolute"', total)} AS "CW_relative",
    {_pct('"CF_absolute"', total)} AS "CF_relative",
    {_pct('"FF_absolute"', total)} AS "FF_relative",
    {_pct('"FW_absolute"', wins)} AS "FW_partial_relative",
    {_pct('"CW_absolute"', wins)} AS "CW_partial_relative",
    {_pct('"FF_absolute"', fails)} AS "FF_partial_relative",
    {_pct('"CF_absolute"', fails)} AS "CF_partial_relative",
    {fail_rate} AS fail_rate_relative,
    100 - {fail_rate} AS win_rate_relative,
    {_pct("first_attempt_absolute", total)} AS first_attempt_relative
  FROM grouped
)"""


_SHOWN = (
    "level_group BETWEEN 3 AND 12 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'"
)
_SEVERAL = """level_cohort BETWEEN 2 AND 15
  AND partition_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'
  AND payer_type = 'payer' AND traffic_type IN ('1-URGENT', '2-HIGH')
  AND platform_name IN ('O', 'F') AND attempt >= 2 AND super_ball"""

_LINEITEM_STATS = f"WITH {_LINEITEM_ATTEMPTS}, {_stats()}"


def _metric(name: str, method: str, count: str, sample: str, low: str, source="stats") -> str:
    return f"""SELECT level_group, date, "{name}_{method}" AS value, '{name}' AS metric_name,
  '{method}' AS calculation_method, "{count}" AS value_count, "{sample}" AS sample_count,
  {low} AS is_low_sample FROM {source}"""


# Failure share in narrow level buckets: some cells are missing.
_NARROW = f"""{_LINEITEM_ATTEMPTS.replace("l_partkey / 100.0", "l_partkey / 10.0")}, {_stats()},
cells AS ({_metric("fail_rate", "relative", "failed_absolute", "attempts_absolute", "attempts_absolute < 3")})"""

_DENSE = f"""{_NARROW},
dense AS (
  SELECT level_group, date, value, metric_name, calculation_method, value_count, sample_count,
    is_low_sample
  FROM (SELECT DISTINCT level_group FROM cells)
  CROSS JOIN (SELECT DISTINCT date FROM cells)
  LEFT JOIN cells USING (level_group, date)
)"""

# --- sources, contract, sinks ------------------------------------------------

ORACLE["scan_table"] = f"WITH {_EVENT_ATTEMPTS} SELECT {_ATTEMPT_COLUMNS} FROM attempts"
ORACLE["scan_sql"] = ORACLE["scan_table"]
ORACLE["scan_projected"] = f"WITH {_LINEITEM_ATTEMPTS} SELECT {_ATTEMPT_COLUMNS} FROM attempts"
ORACLE["contract_sorted"] = (
    f"{ORACLE['scan_table']} ORDER BY partition_date, level_cohort, user_id, balance_id"
)
ORACLE["sink_roundtrip"] = ORACLE["scan_table"]

ORACLE["contract_project"] = f"""WITH {_EVENTS}
SELECT
  CASE WHEN value <= 200 THEN date_trunc('second', ts) END AS client_time,
  CASE WHEN k <> 3 THEN CAST(user_id AS VARCHAR) END AS user_id,
  k AS balance_id,
  CASE WHEN event_type = 'signup' THEN 'NULL' ELSE 'organic' END AS traffic_type,
  CASE WHEN k = 4 THEN NULL WHEN value > 60 THEN 'payer' ELSE 'nonpayer' END AS payer_type,
  CAST(event_type IN ('view', 'error') AS INTEGER) AS failed,
  CASE WHEN k NOT IN (50, 52) THEN 1 + k % 3 END AS attempt,
  CASE WHEN k % 2 = 0 THEN 'ios' ELSE 'android' END AS platform_name,
  CAST(k % 3 = 0 AS INTEGER) AS first_attempt,
  CAST(event_type = 'click' AS INTEGER) AS "FW",
  CAST(event_type = 'purchase' AS INTEGER) AS "CW",
  CAST(event_type = 'view' AS INTEGER) AS "CF",
  CAST(event_type = 'error' AS INTEGER) AS "FF",
  {_SEGMENT} AS reason_seg,
  CASE WHEN k <> 5 THEN CAST(ts AS DATE) END AS partition_date,
  CASE WHEN k <> 6 THEN CAST(floor(k / 10.0) AS INTEGER) END AS level_cohort,
  CASE WHEN value > 50 THEN TRUE WHEN k NOT IN (60, 61) THEN FALSE END AS super_ball
FROM ev"""

ORACLE["contract_rejects"] = f"""WITH {_EVENTS},
texts AS (
  SELECT
    CASE WHEN value > 200 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS client_time,
    CASE WHEN k = 3 THEN '  ' ELSE ' ' || user_id || chr(9) END AS user_id,
    k || '.9' AS balance_id,
    CASE WHEN event_type = 'signup' THEN 'NULL' ELSE ' organic ' END AS traffic_type,
    CASE WHEN k = 4 THEN '' WHEN value > 60 THEN 'payer' ELSE 'nonpayer' END AS payer_type,
    CASE WHEN event_type IN ('view', 'error') THEN ' 1 ' ELSE '0' END AS failed,
    CASE WHEN k = 50 THEN 'abc' WHEN k = 52 THEN '1d' ELSE (1 + k % 3) || 'e0' END AS attempt,
    CASE WHEN k % 2 = 0 THEN 'ios' ELSE 'android' END AS platform_name,
    CAST(k % 3 = 0 AS INTEGER) AS first_attempt,
    CAST(event_type = 'click' AS DOUBLE) AS "FW",
    CAST(event_type = 'purchase' AS DOUBLE) AS "CW",
    CAST(event_type = 'view' AS DOUBLE) AS "CF",
    CAST(event_type = 'error' AS DOUBLE) AS "FF",
    {_SEGMENT} AS reason_seg,
    CASE WHEN k = 5 THEN '2024-13-01' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS partition_date,
    CASE WHEN k <> 6 THEN CAST(floor(k / 10.0) AS BIGINT) END AS level_cohort,
    CASE WHEN value > 50 THEN ' Yes ' WHEN k = 60 THEN 'on' WHEN k = 61 THEN '2' ELSE 'F' END
      AS super_ball,
    concat_ws('; ',
      CASE WHEN value > 200 THEN 'client_time is not a timestamp' END,
      CASE WHEN k = 3 THEN 'user_id is empty' END,
      CASE WHEN k = 4 THEN 'payer_type is empty' END,
      CASE WHEN k IN (50, 52) THEN 'attempt is not a number' END,
      CASE WHEN k = 5 THEN 'partition_date is not a date' END,
      CASE WHEN k = 6 THEN 'level_cohort is not a number' END,
      CASE WHEN k IN (60, 61) AND value <= 50 THEN 'super_ball is not a boolean' END
    ) AS reject_reasons
  FROM ev
)
SELECT * FROM texts WHERE reject_reasons <> ''"""

# --- attempt table build -----------------------------------------------------

_PLAIN_A = "user_id, client_time, event_type, reason, chain_a AS chain"

ORACLE["mart_eligible_users"] = f"WITH {_PLAYERS} SELECT * FROM eligible"
ORACLE["mart_event_filter"] = f"""WITH {_LEVELS} SELECT {_PLAIN_A} FROM levels
WHERE event_type = 'm3.level_finished' AND reason IN ('completed', 'failed')"""
ORACLE["mart_chain_not_like"] = f"""WITH {_LEVELS}
SELECT user_id, client_time, event_type, reason, chain_b AS chain FROM levels
WHERE chain_b NOT LIKE 'WL_%'"""
ORACLE["mart_cutoff"] = f"""WITH {_LEVELS} SELECT {_PLAIN_A} FROM levels
WHERE client_time > TIMESTAMP '2024-01-05 00:00:00' AND partition_date > DATE '2024-01-05'"""
ORACLE["mart_drift_filter"] = f"""WITH {_LEVELS}
SELECT user_id, client_time, event_time FROM levels
WHERE event_time IS NOT NULL
  AND epoch_ms(client_time) // 1000 - epoch_ms(event_time) // 1000 <= 259200"""
ORACLE["mart_user_join"] = f"""WITH {_LEVELS}, {_PLAYERS}
SELECT user_id, client_time, reason, traffic_type FROM levels JOIN eligible USING (user_id)"""
ORACLE["mart_level_id"] = f"""WITH {_LEVELS}
SELECT user_id, client_time, level_id,
  TRY_CAST(regexp_extract(level_id, 'st0*([0-9]+)', 1) AS INTEGER) AS balance_id FROM levels"""
ORACLE["mart_json_fields"] = f"""WITH {_LEVELS}
SELECT user_id, client_time, reason_seg, attempt, super_ball, platform_name FROM levels"""
ORACLE["mart_level_bucket"] = """
SELECT l_orderkey, l_linenumber, CAST(l_partkey - 50 AS INTEGER) AS balance_id,
  CAST(floor((l_partkey - 50) / 75.0) AS INTEGER) AS level_cohort FROM lineitem"""
ORACLE["mart_outcome_flags"] = f"""WITH {_LINEITEM_ATTEMPTS}
SELECT user_id, client_time, reason_seg, "FW", "CW", "CF", "FF" FROM attempts"""
ORACLE["contract_split_rejects"] = ORACLE["contract_rejects"]
ORACLE["contract_accepted"] = f"""SELECT * FROM ({ORACLE["contract_project"]}) AS typed
WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest([{", ".join(f'typed."{c}" IS NULL' for c in ATTEMPT_COLUMNS)}]) AS lost) WHERE lost)"""
ORACLE["mart_outcome_join_spread"] = f"""WITH {_EVENTS}, {_OUTCOMES},
keyed AS (
  SELECT ts AS client_time, CASE WHEN k NOT IN (13, 14) THEN k * 10 END AS balance_id,
    CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS partition_date, event_type FROM ev
),
by_level AS (SELECT balance_id, max("FW") AS "FW", max("CW") AS "CW", max("CF") AS "CF", max("FF") AS "FF" FROM outcomes GROUP BY 1)
SELECT client_time, balance_id, user_id, partition_date, event_type,
  coalesce("FW", 0) AS "FW", coalesce("CW", 0) AS "CW", coalesce("CF", 0) AS "CF", coalesce("FF", 0) AS "FF"
FROM keyed LEFT JOIN by_level USING (balance_id)"""
ORACLE["mart_outcome_join"] = f"""WITH {_EVENTS}, {_OUTCOMES},
keyed AS (
  SELECT ts AS client_time, CASE WHEN k NOT IN (13, 14) THEN k * 10 END AS balance_id,
    CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS partition_date, event_type FROM ev
)
SELECT client_time, balance_id, user_id, partition_date, event_type,
  coalesce("FW", 0) AS "FW", coalesce("CW", 0) AS "CW", coalesce("CF", 0) AS "CF",
  coalesce("FF", 0) AS "FF"
FROM keyed LEFT JOIN outcomes USING (client_time, balance_id, user_id, partition_date)"""
ORACLE["mart_flags_to_segment"] = f"""WITH {_LINEITEM_ATTEMPTS}
SELECT user_id, client_time, balance_id, "FW", "CW", "CF", "FF",
  {_SEGMENT_OF_FLAGS} AS reason_seg FROM attempts"""
ORACLE["mart_a"] = f"WITH {_MART_A} SELECT * FROM mart"
ORACLE["mart_b"] = f"WITH {_MART_B} SELECT * FROM mart"
ORACLE["mart_b_colocated"] = ORACLE["mart_b"]
ORACLE["refresh_one_day"] = f"""WITH {_MART_A}
SELECT * REPLACE (CAST(trunc(TRY_CAST(attempt AS DOUBLE)) AS INTEGER) AS attempt,
  super_ball = 'true' AS super_ball) FROM mart"""
ORACLE["refresh_withdrawn_days"] = f"""WITH {_MART_A}
SELECT * REPLACE (CAST(trunc(TRY_CAST(attempt AS DOUBLE)) AS INTEGER) AS attempt,
  CASE WHEN partition_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-16' THEN super_ball = 'true' END AS super_ball)
FROM mart WHERE partition_date <> DATE '2024-01-12'"""
ORACLE["ab_group_names"] = f"""WITH {_EVENTS}
SELECT 'base' AS group_name FROM ev WHERE event_type IN ('click', 'view')
UNION SELECT 'grp_' || (k % 7) FROM ev WHERE event_type = 'click'
UNION SELECT 'obj_' || (k % 5) FROM ev WHERE event_type = 'view'"""
ORACLE["player_trajectory"] = f"""WITH {_MART_A}
SELECT user_id, client_time, level_cohort, reason_seg FROM mart
WHERE user_id IN (SELECT user_id FROM players WHERE traffic_type = 'crosspromo')"""

ORACLE["trajectory_steps"] = f"""WITH {_MART_A}
SELECT user_id, client_time, level_cohort, reason_seg, CAST(row_number() OVER steps AS INTEGER) AS step,
  lag(level_cohort) OVER steps AS position_before
FROM mart WHERE user_id IN (SELECT user_id FROM players WHERE traffic_type = 'crosspromo')
WINDOW steps AS (PARTITION BY user_id ORDER BY client_time, level_cohort NULLS FIRST, reason_seg)"""
ORACLE["player_lookup"] = f"""WITH {_MART_A}
SELECT user_id, client_time, balance_id, reason_seg FROM mart WHERE user_id IN ('7', '42', '99')"""

# --- filters and options -----------------------------------------------------

_CONDITIONS = {
    "filter_level_range": "level_cohort BETWEEN 2 AND 5",
    "filter_date_range": "partition_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'",
    "filter_payer": "payer_type = 'payer'",
    "filter_traffic": "traffic_type IN ('BUILDING', 'MACHINERY')",
    "filter_platform": "platform_name = 'ios'",
    "filter_attempt_group": "attempt = 1",
    "filter_super_ball": "NOT super_ball",
}
for _name, _condition in _CONDITIONS.items():
    ORACLE[_name] = f"{ORACLE['scan_table']} WHERE {_condition}"
ORACLE["filter_combined"] = f"{ORACLE['scan_projected']} WHERE {_SEVERAL}"
ORACLE["filter_quote_literal"] = f"""WITH {_EVENT_ATTEMPTS},
quoted AS (
  SELECT * REPLACE (
    CASE WHEN super_ball THEN payer_type || '''s cohort' ELSE payer_type END AS payer_type)
  FROM attempts
)
SELECT {_ATTEMPT_COLUMNS} FROM quoted WHERE payer_type IN ('payer', 'payer''s cohort')"""

_BOUNDS = """min(level_cohort) AS level_min, max(level_cohort) AS level_max,
  min(partition_date) AS date_min, max(partition_date) AS date_max"""
_GROUPS = """concat_ws(',', CASE WHEN bool_or(attempt = 1) THEN '1 attempt' END,
    CASE WHEN bool_or(attempt >= 2) THEN '2+ attempts' END) AS attempt_groups"""
_BALLS = """concat_ws(',', CASE WHEN bool_or(super_ball) THEN 'true' END,
    CASE WHEN bool_or(NOT super_ball) THEN 'false' END) AS super_ball_values"""


def _values(column: str) -> str:
    return f"(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM attempts)) AS {column}s"


ORACLE["options_bounds"] = f"WITH {_LINEITEM_ATTEMPTS} SELECT {_BOUNDS} FROM attempts"
ORACLE["options_distinct"] = (
    f"WITH {_EVENT_ATTEMPTS} SELECT DISTINCT traffic_type FROM attempts ORDER BY 1"
)
ORACLE["options_attempt_groups"] = f"WITH {_LINEITEM_ATTEMPTS} SELECT {_GROUPS} FROM attempts"
ORACLE["options_super_ball"] = f"WITH {_EVENT_ATTEMPTS} SELECT {_BALLS} FROM attempts"
ORACLE["options_one_pass"] = f"""WITH {_LINEITEM_ATTEMPTS}
SELECT {_BOUNDS}, {_values("payer_type")}, {_values("traffic_type")}, {_values("platform_name")},
  {_GROUPS}, {_BALLS} FROM attempts"""
_OFFERED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) <= 6 AS is_complete,
  CASE WHEN count(*) <= 6 THEN string_agg(value, ',' ORDER BY n DESC, value) END AS values,
  CASE WHEN count(*) <= 6 THEN string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC, value) END AS counts
FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM attempts WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in ("payer_type", "traffic_type", "balance_id")
)
ORACLE["options_offered"] = f"WITH {_LINEITEM_ATTEMPTS} {_OFFERED}"

# --- statistics and metrics --------------------------------------------------

ORACLE["stats_all"] = f"{_LINEITEM_STATS} SELECT * FROM stats ORDER BY level_group, date"
for _name, _columns in {
    "stats_outcomes": '"FW_absolute", "CW_absolute", "CF_absolute", "FF_absolute", wins_absolute, fails_absolute',
    "stats_counts": "attempts_absolute, failed_absolute, attempt_average, first_attempt_absolute",
    "stats_relative": '"FW_relative", "CW_relative", "CF_relative", "FF_relative"',
    "stats_partial_relative": '"FW_partial_relative", "CW_partial_relative", "FF_partial_relative", "CF_partial_relative"',
    "stats_rates": "fail_rate_relative, win_rate_relative, first_attempt_relative",
}.items():
    ORACLE[_name] = f"{_LINEITEM_STATS} SELECT level_group, date, {_columns} FROM stats"
ORACLE["stats_filtered"] = f"WITH {_LINEITEM_ATTEMPTS}, {_stats(_SEVERAL)} SELECT * FROM stats"
ORACLE["stats_from_segments"] = ORACLE["stats_filtered"]
ORACLE["options_from_segments"] = ORACLE["options_one_pass"]

ORACLE["metric_values"] = f"""{_LINEITEM_STATS}
SELECT level_group, date, attempt_average AS value, 'attempt' AS metric_name,
  'average' AS calculation_method FROM stats"""
ORACLE["metric_context"] = f"""{_LINEITEM_STATS}
{_metric("CF", "partial_relative", "CF_absolute", "fails_absolute", "fails_absolute < 12")}"""
ORACLE["metric_low_sample"] = f"""{_LINEITEM_STATS}
{_metric("win_rate", "relative", "wins_absolute", "attempts_absolute", "attempts_absolute < 30")}"""
ORACLE["display_filter"] = f"{_LINEITEM_STATS} SELECT * FROM stats WHERE {_SHOWN}"
ORACLE["display_filter_equiv"] = ORACLE["display_filter"]
ORACLE["stats_reuse"] = f"""{_LINEITEM_STATS}
{_metric("fail_rate", "relative", "failed_absolute", "attempts_absolute", "attempts_absolute < 30")}
UNION ALL
{_metric("wins", "absolute", "wins_absolute", "attempts_absolute", "FALSE")} WHERE {_SHOWN}"""

# --- grid --------------------------------------------------------------------

ORACLE["grid_duplicates"] = f"""WITH {_LINEITEM_ATTEMPTS}
SELECT level_cohort AS level_group, partition_date AS date, count(*) AS cell_rows
FROM attempts GROUP BY ALL HAVING count(*) > 1"""

_DAY_COLUMNS = ", ".join(f"max(value) FILTER (date = DATE '{day}') AS \"{day}\"" for day in MONTHS)
_LISTED = ", ".join(f"DATE '{day}'" for day in MONTHS)
ORACLE["grid_pivot"] = f"""WITH {_NARROW}
SELECT level_group, {_DAY_COLUMNS} FROM cells
WHERE CASE WHEN date IN ({_LISTED}) THEN TRUE ELSE error('a cell on a day that is not listed') END
GROUP BY level_group"""
ORACLE["grid_records"] = (
    f"WITH {_NARROW} SELECT level_group, date, value FROM cells WHERE value IS NOT NULL"
)
ORACLE["grid_block_records"] = ORACLE["grid_records"]
ORACLE["grid_dense"] = f"WITH {_DENSE} SELECT * FROM dense"
_VISIBLE = "CASE WHEN NOT coalesce(is_low_sample, FALSE) THEN value END AS visible_value"
ORACLE["grid_masked"] = f"WITH {_DENSE} SELECT *, {_VISIBLE} FROM dense"
ORACLE["grid_bounds"] = f"""WITH {_NARROW}
SELECT min(value) AS value_min, max(value) AS value_max FROM cells WHERE NOT is_low_sample"""
ORACLE["grid_cell_details"] = f"""WITH {_DENSE}
SELECT level_group, date, value_count, sample_count,
  CASE WHEN is_low_sample THEN 'мало данных' ELSE 'достаточно' END AS reliability, value
FROM dense"""
ORACLE["grid_clamped"] = f"""{_LINEITEM_STATS},
masked AS (
  SELECT level_group, date, win_rate_relative AS value,
    CASE WHEN attempts_absolute >= 30 THEN win_rate_relative END AS visible_value FROM stats
),
ends AS (
  SELECT least(greatest(60.0::DOUBLE, min(visible_value)), max(visible_value)) AS lo,
    least(greatest(75.0::DOUBLE, min(visible_value)), max(visible_value)) AS hi FROM masked
),
colored AS (
  SELECT masked.*, lo, hi, CASE WHEN visible_value IS NULL THEN NULL
      WHEN lo < hi THEN least(greatest(visible_value, lo), hi) ELSE visible_value END AS color_value
  FROM masked, ends
)
SELECT level_group, date, value, visible_value, color_value,
  CASE WHEN lo < hi THEN (color_value - lo) / (hi - lo) END AS color_position FROM colored"""
ORACLE["grid_request"] = f"""WITH {_EVENT_ATTEMPTS}, {_stats()},
cells AS ({_metric("fail_rate", "relative", "failed_absolute", "attempts_absolute", "attempts_absolute < 30")})
SELECT *, {_VISIBLE} FROM cells"""

ORACLE["grid_from_segments"] = ORACLE["grid_request"]
ORACLE["grid_from_runs"] = f"SELECT * FROM ({ORACLE['grid_request']}) WHERE level_group <> 4"

# --- status and health -------------------------------------------------------

ORACLE["latest_partition"] = (
    f"WITH {_EVENT_ATTEMPTS} SELECT max(partition_date) AS latest_partition FROM attempts"
)
ORACLE["dataset_status"] = """
SELECT 'events' AS project, 'event_attempts' AS table_name, TRUE AS rebuild_requested,
  CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS latest_partition
FROM events JOIN customer ON user_id = c_custkey
UNION ALL
SELECT 'lineitem', 'lineitem_attempts', FALSE,
  CAST(CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS VARCHAR)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT 'missing', 'no_such_attempts', FALSE, 'недоступно: AnalysisException'"""
_DAY_COUNTS = """counts AS (
  SELECT partition_date, count(*) AS attempts, CASE WHEN partition_date IS NOT NULL THEN
    partition_date - lag(partition_date) OVER (PARTITION BY partition_date IS NULL ORDER BY partition_date) - 1 END AS missing_before
  FROM attempts GROUP BY partition_date)"""
ORACLE["mart_health_days"] = f"""WITH {_LINEITEM_ATTEMPTS},
counts AS (SELECT partition_date, count(*) AS attempts FROM attempts GROUP BY 1),
calendar AS (
  SELECT CAST(unnest(generate_series(min(partition_date), max(partition_date), INTERVAL 1 DAY)) AS DATE) AS d FROM counts)
SELECT d AS partition_date, coalesce(attempts, 0) AS attempts,
  CAST(d - max(partition_date) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS INTEGER) AS missing_before
FROM calendar LEFT JOIN counts ON d = partition_date
UNION ALL SELECT partition_date, attempts, NULL FROM counts WHERE partition_date IS NULL"""
_STRAY_DAYS = f"""{_EVENT_ATTEMPTS.replace("attempts AS (", "dated AS (", 1)},
attempts AS (SELECT * REPLACE (CASE WHEN day(partition_date) = 5 THEN DATE '1900-01-01'
    WHEN day(partition_date) = 20 THEN DATE '2200-12-31'
    WHEN day(partition_date) NOT IN (6, 7) THEN partition_date END AS partition_date) FROM dated), {_DAY_COUNTS}"""
ORACLE["mart_health_gaps"] = f"""WITH {_STRAY_DAYS}
SELECT CAST(partition_date - CAST(missing_before AS INTEGER) AS DATE) AS first_missing,
  CAST(partition_date - 1 AS DATE) AS last_missing, CAST(missing_before AS INTEGER) AS days
FROM counts WHERE missing_before > 0"""
ORACLE["mart_health_runs"] = f"""WITH {_STRAY_DAYS}
SELECT min(partition_date) AS first_day, max(partition_date) AS last_day, count(*) AS days,
  CAST(sum(attempts) AS BIGINT) AS attempts
FROM (SELECT *, partition_date - DATE '1900-01-01' - row_number() OVER (ORDER BY partition_date) AS run
  FROM counts WHERE partition_date IS NOT NULL)
GROUP BY run"""
ORACLE["mart_health_cohorts"] = (
    f"WITH {_MART_A} SELECT level_cohort, count(*) AS attempts FROM mart GROUP BY 1"
)
ORACLE["mart_health_nulls"] = f"""WITH {_MART_B}
SELECT count(*) AS attempts,
  count(*) FILTER (balance_id IS NULL) AS no_balance_id,
  count(*) FILTER (level_cohort IS NULL) AS no_level_cohort,
  count(*) FILTER (traffic_type IS NULL) AS no_traffic_type,
  count(*) FILTER (payer_type IS NULL) AS no_payer_type,
  count(*) FILTER (platform_name IS NULL) AS no_platform_name,
  count(*) FILTER (attempt IS NULL) AS no_attempt,
  count(*) FILTER (super_ball IS NULL) AS no_super_ball,
  count(*) FILTER (reason_seg = 'unknown') AS unknown_outcome
FROM mart"""
