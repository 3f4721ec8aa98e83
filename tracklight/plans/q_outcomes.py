"""Queries: scans, keys, outcomes, base rates, appearances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions import tables
from tracklight.operators import discovery as ds
from tracklight.operators import outcomes as oc
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY, OUTCOME_CLASSES, PREDICTIVE, DiscoveryConfig, OutcomeConfig
from tracklight.sources import adapters, scans

#: Thresholds for the two grains of the driver tables.
K = OutcomeConfig(run_least_volume=0.0, drawdown=0.98, dormant_days=8, dormant_gap_days=3, dormant_most_volume=1e12, wake_multiple=2.0, wake_days=3, dormant_least_candles=10, dormant_least_baseline=4)
PART = OutcomeConfig(run_baseline_days=56, run_least_volume=0.0, drawdown=0.98, dormant_days=200, dormant_gap_days=60, dormant_most_volume=1e12, wake_multiple=3.0, wake_days=60, pump_gap_days=120, dormant_least_candles=10, dormant_least_baseline=2)
K_DISCOVERY = DiscoveryConfig(lookback_days=(1, 3, 7), min_events=2, min_independent=1, independence_days=5)
AS_OF = "2024-01-25 00:00:00"
AS_OF_US = 1_706_140_800_000_000


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def k_outcomes(spark, sf_dir):
    """The outcomes of the clickstream and its listings, written once."""
    events = adapters.clickstream_events(spark, sf_dir)
    return tables.keep(oc.detect_all(adapters.clickstream_candles(spark, sf_dir), K).unionByName(adapters.clickstream_listings(events)))


def k_assets(spark, sf_dir):
    return tables.keep(adapters.assets_of(adapters.clickstream_events(spark, sf_dir)))


def shown(outcomes):
    """Outcomes with their times in microseconds."""
    return outcomes.select("outcome_id", "outcome_class", "asset_id", F.unix_micros("t0").alias("t0"), F.unix_micros("first_observed_at").alias("seen"), "magnitude")


PIT_SQL = sql.with_(sql.EVENTS) + f"SELECT event_id, event_type, actor, asset_id, side, usd_value, us FROM ev WHERE us <= {AS_OF_US} AND us >= {AS_OF_US - 7 * DAY}"


@query("pit_event_scan", PIT_SQL)
def pit_event_scan(spark, sf_dir):
    seen = scans.observed_events(adapters.clickstream_events(spark, sf_dir), as_of(), since=F.timestamp_micros(F.lit(AS_OF_US - 7 * DAY)))
    return seen.select("event_id", "event_type", "actor", "asset_id", "side", "usd_value", F.unix_micros("observed_at").alias("us"))


@query("event_type_counts", sql.with_(sql.EVENTS) + "SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def event_type_counts(spark, sf_dir):
    return adapters.clickstream_events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "coverage",
    sql.with_(sql.EVENTS, sql.CANDLES_K, sql.outcomes(K)) + "SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(DISTINCT asset_id) FROM ev) AS assets, (SELECT count(*) FROM oc) AS outcomes, (SELECT max(us) FROM ev) AS newest",
)
def coverage(spark, sf_dir):
    events = adapters.clickstream_events(spark, sf_dir)
    of_events = events.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("asset_id").alias("assets"), F.unix_micros(F.max("observed_at")).alias("newest"))
    of_outcomes = oc.detect_all(adapters.clickstream_candles(spark, sf_dir), K).agg(F.count(F.lit(1)).alias("outcomes"))
    return of_events.join(F.broadcast(of_outcomes)).select("events", "assets", "outcomes", "newest")  # one row each


@query(
    "event_keys",
    "SELECT 'evt_' || substr(sha256(concat_ws(chr(31), 'market', l_orderkey::VARCHAR, 'swap', l_linenumber::VARCHAR, l_partkey::VARCHAR)), 1, 32) AS event_id, count(*) AS n FROM lineitem GROUP BY 1",
)
def event_keys(spark, sf_dir):
    line = adapters.read(spark, sf_dir, "lineitem")
    key = fn.event_key("market", F.col("l_orderkey"), F.lit("swap"), F.col("l_linenumber"), F.col("l_partkey"))
    return line.groupBy(key.alias("event_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "address_normalize",
    """SELECT raw, network, CASE WHEN valid THEN CASE WHEN network = 'solana' THEN trim(raw) ELSE lower(trim(raw)) END END AS address, valid,
  CASE WHEN length(trim(raw)) > 11 THEN left(trim(raw), 4) || '…' || right(trim(raw), 4) ELSE trim(raw) END AS shown
FROM (SELECT raw, network, CASE WHEN network = 'solana' THEN regexp_matches(trim(raw), '^[1-9A-HJ-NP-Za-km-z]{32,44}$') ELSE regexp_matches(trim(raw), '^0x[0-9a-fA-F]{40}$') END AS valid
  FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN ' 0x' || upper(substr(sha256(c_custkey::VARCHAR), 1, 40)) || ' ' WHEN 1 THEN replace(substr(sha256(c_custkey::VARCHAR), 1, 40), '0', 'x') ELSE c_name END AS raw,
    CASE c_custkey % 2 WHEN 0 THEN 'bsc' ELSE 'solana' END AS network FROM customer))""",
)
def address_normalize(spark, sf_dir):
    key = F.col("c_custkey")
    hashed = F.substring(F.sha2(key.cast("string"), 256), 1, 40)
    raw = F.when(key % 3 == 0, F.concat(F.lit(" 0x"), F.upper(hashed), F.lit(" "))).when(key % 3 == 1, F.replace(hashed, F.lit("0"), F.lit("x"))).otherwise(F.col("c_name"))
    rows = adapters.read(spark, sf_dir, "customer").select(raw.alias("raw"), F.when(key % 2 == 0, "bsc").otherwise("solana").alias("network"))
    a, n = F.col("raw"), F.col("network")
    return rows.select("raw", "network", fn.normalize_address(a, n).alias("address"), fn.is_valid_address(a, n).alias("valid"), fn.display_address(F.trim(a)).alias("shown"))


@query("token_amounts", "SELECT p_partkey, p_retailprice * 100 / 10.0 ** (p_size % 19) AS amount, p_size % 19 AS decimals FROM (SELECT p_partkey, round(p_retailprice, 0) AS p_retailprice, p_size FROM part)")
def token_amounts(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part")
    raw, decimals = (F.round("p_retailprice", 0) * 100).cast("decimal(38,0)"), F.col("p_size") % 19
    return part.select("p_partkey", fn.scale_amount(raw, decimals).alias("amount"), decimals.alias("decimals"))


@query("defang_urls", "SELECT page_id, trim(replace(replace(url, 'http', 'hxxp'), chr(10), ' ')) AS safe, sha256(url) AS url_hash FROM pages")
def defang_urls(spark, sf_dir):
    return adapters.read(spark, sf_dir, "pages").select("page_id", fn.defang(F.col("url")).alias("safe"), fn.content_hash(F.col("url")).alias("url_hash"))


def _outcome_query(name, cte, make):
    select = f"SELECT outcome_id, outcome_class, asset_id, t0, seen, magnitude FROM {cte}"
    for grain, candles, cfg, read in (("", sql.CANDLES_PART, PART, adapters.market_candles), ("_hourly", sql.CANDLES_K, K, adapters.clickstream_candles)):
        query(name + grain, sql.with_(candles, sql.outcomes(cfg)) + select)(lambda spark, sf_dir, cfg=cfg, read=read: shown(make(read(spark, sf_dir), cfg)))


_outcome_query("price_runs", "run", oc.price_runs)
_outcome_query("revivals", "rev", oc.revivals)
_outcome_query("collapses", "col", oc.collapses)
_outcome_query("pump_events", "pump", oc.pump_events)
_outcome_query("detect_all", "oc", oc.detect_all)


@query(
    "outcome_evidence",
    sql.with_(sql.CANDLES_K, sql.outcomes(K))
    + f"""SELECT outcome_id, definition_version, keys, round(number, 6) AS number, coalesce(runs_id, '') AS runs_id FROM (
  SELECT run.outcome_id, '1' AS definition_version, 'baseline,peak' AS keys, cw.close - cw.base AS number, NULL AS runs_id FROM run JOIN cw ON cw.asset_id = run.asset_id AND cw.s = run.t0
  UNION ALL SELECT rev.outcome_id, '1', 'dormant_avg_vol,dormant_days', cw.dav + {K.dormant_days}, NULL FROM rev JOIN cw ON cw.asset_id = rev.asset_id AND cw.s = rev.t0
  UNION ALL SELECT col.outcome_id, '1', 'peak', cw.pk, NULL FROM col JOIN cw ON cw.asset_id = col.asset_id AND cw.s = col.t0
  UNION ALL SELECT pump.outcome_id, '1', 'collapse_outcome_id,hours_to_collapse,run_outcome_id', round(hours, 1), replace(pump.outcome_id, 'pump_event', 'price_run') FROM pump)""",
)
def outcome_evidence(spark, sf_dir):
    """The evidence of every outcome: the names of its entries, and their numbers."""
    of = lambda k: F.coalesce(F.col("evidence")[k].cast("double"), F.lit(0.0))
    number = F.when(F.col("outcome_class") == "price_run", of("peak") - of("baseline")).otherwise(of("dormant_avg_vol") + of("dormant_days") + of("peak") + of("hours_to_collapse"))
    return oc.detect_all(adapters.clickstream_candles(spark, sf_dir), K).select(
        "outcome_id", "definition_version", F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("keys"), F.round(number, 6).alias("number"), F.coalesce(F.col("evidence")["run_outcome_id"], F.lit("")).alias("runs_id")
    )


@query("detected_counts", sql.with_(sql.CANDLES_K, sql.outcomes(K)) + "SELECT outcome_class, count(*) AS written FROM oc WHERE asset_id NOT LIKE '%7' GROUP BY 1")
def detected_counts(spark, sf_dir):
    """What a detection adds to a table that holds the outcomes of some assets already."""
    found = oc.detect_all(adapters.clickstream_candles(spark, sf_dir), K)
    return oc.detected_counts(oc.insert_new(found.where(F.col("asset_id").endswith("7")), found))

RATES_SQL = f"""
SELECT *, round(hits / total, 9) AS rate FROM (
  SELECT c AS outcome_class, (SELECT count(DISTINCT asset_id) FROM o WHERE outcome_class = c AND seen <= {AS_OF_US}) AS hits,
    (SELECT count(*) FROM ast WHERE first_seen <= {AS_OF_US}) AS total
  FROM (SELECT unnest({list(OUTCOME_CLASSES)}) AS c))"""
ALL_OUTCOMES = "o AS (SELECT * FROM oc UNION ALL SELECT * FROM lst)"
BASE = (sql.EVENTS, sql.CANDLES_K, sql.outcomes(K), sql.LISTINGS, ALL_OUTCOMES, sql.ASSETS)


@query("base_rates", sql.with_(*BASE) + RATES_SQL)
def base_rates(spark, sf_dir):
    return oc.base_rates(k_outcomes(spark, sf_dir), k_assets(spark, sf_dir), as_of(), OUTCOME_CLASSES).withColumn("rate", F.round("rate", 9))


@query("observable_outcomes", sql.with_(*BASE) + f"SELECT outcome_id, outcome_class, asset_id, t0, seen, magnitude FROM o WHERE seen <= {AS_OF_US} AND outcome_class IN {PREDICTIVE}")
def observable_outcomes(spark, sf_dir):
    return shown(oc.observable(k_outcomes(spark, sf_dir), as_of(), PREDICTIVE))


APPEARANCES = f"""
app AS (
  SELECT o.outcome_id, o.outcome_class, o.asset_id, o.t0, ev.actor, min(ev.us) AS entered_at, arg_min(ev.usd_value, struct_pack(a := ev.us, b := ev.event_id)) AS usd_value
  FROM o JOIN ev ON ev.asset_id = o.asset_id AND ev.us < o.t0 AND ev.us >= o.t0 - {7 * DAY}
  WHERE ev.side IN ('buy', 'long') AND o.seen <= {AS_OF_US} AND o.outcome_class IN {PREDICTIVE} GROUP BY ALL
)"""


@query(
    "appearances",
    sql.with_(*BASE, APPEARANCES) + f"SELECT actor, outcome_id, asset_id, t0, entered_at, usd_value, round((t0 - entered_at) / {DAY}.0, 6) AS lead_time_days, CASE WHEN t0 - entered_at <= {DAY} THEN '1d' WHEN t0 - entered_at <= {3 * DAY} THEN '3d' ELSE '7d' END AS \"window\" FROM app",
)
def appearances(spark, sf_dir):
    found = k_appearances(spark, sf_dir)
    return found.select("actor", "outcome_id", "asset_id", F.unix_micros("t0").alias("t0"), F.unix_micros("entered_at").alias("entered_at"), "usd_value", F.round("lead_time_days", 6).alias("lead_time_days"), "window")


def k_appearances(spark, sf_dir):
    return ds.appearances(adapters.clickstream_events(spark, sf_dir), oc.observable(k_outcomes(spark, sf_dir), as_of(), PREDICTIVE), K_DISCOVERY)


#: Candidates of the clickstream: actors early to two assets or more; those early to many stand for operators.
TRACKED = "tr AS (SELECT actor AS wallet, CASE WHEN count(DISTINCT asset_id) >= 12 THEN 'pump_operator' ELSE 'informed_accumulator' END AS archetype, count(DISTINCT asset_id) / 2.0 AS edge, max(t0) AS surfaced FROM app GROUP BY 1 HAVING count(DISTINCT asset_id) >= 2)"
TRACKED_PARTS = (*BASE, APPEARANCES, TRACKED)


def tracked(spark, sf_dir):
    """The candidates, written once."""
    n = F.countDistinct("asset_id")
    found = k_appearances(spark, sf_dir).groupBy(F.col("actor").alias("wallet")).agg(n.alias("n"), F.max("t0").alias("surfaced_at")).where("n >= 2")
    return tables.keep(found.select("wallet", F.when(F.col("n") >= 12, "pump_operator").otherwise("informed_accumulator").alias("archetype"), (F.col("n") / 2).alias("edge_vs_base"), "surfaced_at", F.lit("tracked").alias("status")))


@query("appearance_counts", sql.with_(*BASE, APPEARANCES) + "SELECT actor, count(*) AS appearances, count(DISTINCT asset_id) AS assets FROM app GROUP BY 1")
def appearance_counts(spark, sf_dir):
    return k_appearances(spark, sf_dir).groupBy("actor").agg(F.count(F.lit(1)).alias("appearances"), F.countDistinct("asset_id").alias("assets"))


@query(
    "independent_events",
    sql.with_(*BASE, APPEARANCES.strip() + f""", fa AS (
  SELECT actor, list_sort(list(t)) AS ts FROM (SELECT actor, asset_id, min(t0) AS t FROM app GROUP BY 1, 2) GROUP BY 1
)""").replace("WITH ", "WITH RECURSIVE ", 1) + f""", r(actor, ts, i, anchor, n) AS (
  SELECT actor, ts, 1::BIGINT, ts[1], 1::BIGINT FROM fa
  UNION ALL SELECT actor, ts, i + 1, CASE WHEN ts[i + 1] - anchor > {5 * DAY} THEN ts[i + 1] ELSE anchor END, n + CASE WHEN ts[i + 1] - anchor > {5 * DAY} THEN 1 ELSE 0 END FROM r WHERE i < len(ts)
) SELECT actor, max(n) AS independent_events FROM r GROUP BY 1""",
)
def independent_events(spark, sf_dir):
    return ds.independent_events(k_appearances(spark, sf_dir), K_DISCOVERY)
