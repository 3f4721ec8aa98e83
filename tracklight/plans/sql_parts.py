"""SQL of the canonical tables, shared by the SQL twins of the queries. Times are microseconds."""

from __future__ import annotations

import re

from tracklight.schema import CRITICAL_FAMILIES, DAY, HOUR, MUTED_FAMILIES, AlertConfig, OutcomeConfig

EVENTS = """
ev0 AS (
  SELECT event_id AS raw_id, epoch_us(ts) AS us, user_id::VARCHAR AS actor, 'k:' || (props->>'$.k') AS asset_id, value AS usd_value, event_type <> 'view' AS filled,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'swap' WHEN event_type = 'view' THEN 'order_placed' WHEN event_type = 'signup' THEN 'position_opened' WHEN event_type = 'error' THEN 'liquidation' ELSE 'unknown_interaction' END AS event_type,
    CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'click' THEN 'sell' WHEN event_type IN ('view', 'signup') THEN 'long' END AS side
  FROM events
), ev AS (
  SELECT 'evt_' || substr(sha256(concat_ws(chr(31), 'clicks', raw_id::VARCHAR, event_type, '0', '0')), 1, 32) AS event_id, * EXCLUDE (raw_id),
    (event_type = 'swap' AND coalesce(side = 'buy', false)) OR event_type IN ('position_opened', 'position_increased') AS acquired
  FROM ev0
)"""

CANDLES_K = f"""
cd AS (
  SELECT 'k:' || (props->>'$.k') AS asset_id, (epoch_us(ts) // {6 * HOUR}) * {6 * HOUR} AS s, median(value) AS close, sum(value) AS volume
  FROM events GROUP BY 1, 2
)"""

CANDLES_PART = f"""
cd AS (
  SELECT 'part:' || l_partkey::VARCHAR AS asset_id, (epoch_us(l_shipdate) // {7 * DAY}) * {7 * DAY} AS s, median(l_extendedprice / l_quantity) AS close, sum(l_extendedprice) AS volume
  FROM lineitem GROUP BY 1, 2
)"""


def outcomes(c: OutcomeConfig) -> str:
    """CTEs run, rev, col, pump and oc (all of them) over cd(asset_id, s, close, volume)."""
    d = lambda n: int(n * DAY)
    gap = d(c.dormant_gap_days)
    part = "PARTITION BY asset_id ORDER BY s"

    def found(cls: str, alias: str, condition: str, magnitude: str, least: int) -> str:
        return f"""
{alias} AS (
  SELECT 'out_{cls}_' || substr(split_part(asset_id, ':', 2), 1, 10) || '_' || (t0 // 1000000)::VARCHAR AS outcome_id, '{cls}' AS outcome_class, asset_id, t0, t0 + {int(c.confirmation_hours * HOUR)} AS seen, round_even(m, 3) AS magnitude
  FROM (SELECT asset_id, min(s) FILTER ({condition}) AS t0, arg_min({magnitude}, s) FILTER ({condition}) AS m, count(*) AS n FROM cw GROUP BY asset_id)
  WHERE t0 IS NOT NULL AND n >= {least}
)"""

    return f"""
cw AS (
  SELECT *, min(close) OVER b AS base, avg(volume) OVER b AS av, count(*) OVER b AS nb,
    max(close) OVER (PARTITION BY asset_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS pk,
    count(*) OVER dm AS dn, avg(volume) OVER dm AS dav, max(close) OVER dm AS dbase,
    max(close) OVER ({part} RANGE BETWEEN CURRENT ROW AND {d(c.wake_days)} FOLLOWING) AS fw
  FROM cd
  WINDOW b AS ({part} RANGE BETWEEN {d(c.run_baseline_days)} PRECEDING AND 1 PRECEDING),
    dm AS ({part} RANGE BETWEEN {gap + d(c.dormant_days)} PRECEDING AND {gap + 1} PRECEDING)
), {found('price_run', 'run', f'nb >= {c.run_least_baseline} AND base > 0 AND av >= {c.run_least_volume} AND close / base >= {c.run_multiple}', 'close / base', c.run_least_candles)},
{found('revival', 'rev', f'dn >= {c.dormant_least_baseline} AND dav <= {c.dormant_most_volume} AND dbase > 0 AND fw / dbase >= {c.wake_multiple}', 'fw / dbase', c.dormant_least_candles)},
{found('rug_or_collapse', 'col', f'pk > 0 AND (pk - close) / pk >= {c.drawdown}', '(pk - close) / pk', c.collapse_least_candles)},
pump AS (
  SELECT replace(run.outcome_id, 'price_run', 'pump_event') AS outcome_id, 'pump_event' AS outcome_class, run.asset_id, run.t0, col.seen, run.magnitude, (col.t0 - run.t0) / {HOUR}.0 AS hours
  FROM run JOIN col ON run.asset_id = col.asset_id WHERE col.t0 > run.t0 AND col.t0 - run.t0 <= {d(c.pump_gap_days)}
), oc AS (
  SELECT * FROM run UNION ALL SELECT * FROM rev UNION ALL SELECT * FROM col UNION ALL SELECT * EXCLUDE (hours) FROM pump
)"""


#: A stand-in for the listing feed: the first opened position of each asset.
LISTINGS = """
lst AS (
  SELECT 'out_cex_listing_' || substr(split_part(asset_id, ':', 2), 1, 10) || '_' || (t0 // 1000000)::VARCHAR AS outcome_id, 'cex_listing' AS outcome_class, asset_id, t0, t0 AS seen, NULL::DOUBLE AS magnitude
  FROM (SELECT asset_id, min(us) AS t0 FROM ev WHERE event_type = 'position_opened' AND asset_id IS NOT NULL GROUP BY 1)
)"""

ASSETS = "ast AS (SELECT asset_id, min(us) AS first_seen FROM ev WHERE asset_id IS NOT NULL GROUP BY 1)"


def decisions(n, signals: str, past: str, alert: AlertConfig) -> str:
    """CTEs top{n} and dec{n}, for WITH RECURSIVE: the run's signals (family, asset_id, wallet, us, significance) with place i,
    and with the policy's decision, taken signal by signal over the stored ones (the same columns, and delivered)."""
    muted, critical = (", ".join(f"'{f}'" for f in x) for x in (MUTED_FAMILIES, CRITICAL_FAMILIES))
    keys = f"family || ':' || coalesce(asset_id, '-') || ':' || coalesce(wallet, '-') || ':' || (us // {DAY}) AS key, family || ':' || coalesce(asset_id, '') || ':' || coalesce(wallet, '') AS subject"
    cooldown = int(alert.cooldown_hours * HOUR)
    return f"""top{n} AS (
  SELECT *, {keys}, family IN ({critical}) AS critical FROM (SELECT *, row_number() OVER (ORDER BY significance DESC, us, family, asset_id NULLS FIRST, wallet NULLS FIRST) AS i FROM ({signals})) WHERE i <= {alert.max_per_run}
),
past{n} AS (SELECT *, {keys} FROM ({past})),
ask{n} AS (
  SELECT t.*, EXISTS (SELECT 1 FROM past{n} p WHERE p.key = t.key) AS dup, EXISTS (SELECT 1 FROM past{n} p WHERE p.subject = t.subject AND t.us - p.us BETWEEN 0 AND {cooldown}) AS near,
    (SELECT count(*) FROM past{n} p WHERE p.delivered AND p.us // {DAY} = t.us // {DAY}) AS told FROM top{n} t
),
fold{n} AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS decision, []::VARCHAR[] AS keys, []::STRUCT(subject VARCHAR, us BIGINT)[] AS kept, []::BIGINT[] AS days
  UNION ALL
  SELECT i, decision, CASE WHEN decision IN ('duplicate', 'threshold', 'cooldown') THEN keys ELSE list_append(keys, key) END, CASE WHEN decision IN ('duplicate', 'threshold', 'cooldown') THEN kept ELSE list_append(kept, {{'subject': subject, 'us': us}}) END,
    CASE WHEN decision = 'delivered' THEN list_append(days, us // {DAY}) ELSE days END
  FROM (
    SELECT a.i, a.key, a.subject, a.us, keys, kept, days, CASE
      WHEN dup OR list_contains(keys, a.key) THEN 'duplicate' WHEN significance < {alert.threshold} AND NOT critical THEN 'threshold'
      WHEN NOT critical AND (near OR len(list_filter(kept, lambda k: k.subject = a.subject AND a.us - k.us BETWEEN 0 AND {cooldown})) > 0) THEN 'cooldown'
      WHEN family IN ({muted}) AND NOT critical THEN 'muted'
      WHEN NOT critical AND told + len(list_filter(days, lambda d: d = a.us // {DAY})) >= {alert.max_per_day} THEN 'daily_cap' ELSE 'delivered' END AS decision
    FROM fold{n} f JOIN ask{n} a ON a.i = f.i + 1
  )
),
dec{n} AS (SELECT t.*, decision FROM top{n} t JOIN fold{n} USING (i))"""


def at(text: str, moment: int, of: int) -> str:
    """SQL of the moment ``of``, at another moment: all times in it move along."""
    return re.sub(r"\b17\d{14}\b", lambda m: str(int(m[0]) + moment - of), text)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().removesuffix(",") for p in parts) + "\n"
