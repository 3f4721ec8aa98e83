"""Queries: whole jobs over the clickstream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.functions.temporal import ticks
from tracklight.operators import discovery as ds
from tracklight.operators import outcomes as oc
from tracklight.operators import policy
from tracklight.operators import signals as sg
from tracklight.operators import sweep
from tracklight.plans import q_graph as qg
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_signals as qs
from tracklight.plans import q_wallets as qw
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY
from tracklight.sources import adapters


@query(
    "sweep_report",
    sql.with_(sql.EVENTS, sql.CANDLES_K, "tv AS (SELECT asset_id, max(volume) AS peak, arg_max(volume, s) AS last FROM cd GROUP BY 1 HAVING max(volume) >= 100)", "cd2 AS (SELECT cd.* FROM cd SEMI JOIN tv USING (asset_id))")
    + ", " + sql.outcomes(qo.K).replace("FROM cd\n", "FROM cd2\n").strip()
    + """, su AS (SELECT DISTINCT actor FROM oc JOIN ev ON ev.asset_id = oc.asset_id AND us < t0 AND us >= t0 - 2592000000000 WHERE event_type = 'swap' AND side = 'buy'),
ap AS (SELECT DISTINCT ev.actor FROM oc JOIN ev ON ev.asset_id = oc.asset_id AND us < t0 AND us >= t0 - 604800000000 SEMI JOIN su ON su.actor = ev.actor WHERE side IN ('buy', 'long') AND oc.seen <= """ + str(qo.AS_OF_US) + """ AND outcome_class IN ('price_run', 'cex_listing', 'revival'))
SELECT 'assets_priced' AS key, count(DISTINCT asset_id)::DOUBLE AS value FROM cd UNION ALL SELECT 'assets_tradable', count(*) FROM tv UNION ALL SELECT 'assets_dead', count(*) FILTER (last < 0.05 * peak) FROM tv
UNION ALL SELECT 'suspects_found', count(*) FROM su UNION ALL SELECT 'suspects_taken', count(*) FROM su UNION ALL SELECT 'scored', count(DISTINCT actor) FROM ap UNION ALL SELECT 'parse_coverage', 1 - count(*) FILTER (event_type = 'unknown_interaction') / count(*) FROM ev
UNION ALL SELECT 'outcomes_' || outcome_class, count(*) FROM oc GROUP BY 1""",
)
def sweep_report(spark, sf_dir):
    events = adapters.clickstream_events(spark, sf_dir)
    found = sweep.two_pass(events, adapters.clickstream_candles(spark, sf_dir), adapters.assets_of(events), qo.as_of(), peak_volume=100.0, detect=qo.K, discover=qo.K_DISCOVERY, wallets=qw.WALLETS)
    return found.report.where("key <> 'passed'")


@query("provenance", sql.with_(*qo.BASE, qo.APPEARANCES) + """SELECT actor, count(*)::INTEGER AS items, min(t0) AS first_t0, round(sum(round((t0 - entered_at) / 86400000000.0, 2)), 2) AS lead,
string_agg(outcome_id || ' ' || asset_id || ' ' || CASE WHEN t0 - entered_at <= 86400000000 THEN '1d' WHEN t0 - entered_at <= 259200000000 THEN '3d' ELSE '7d' END, ',' ORDER BY t0, outcome_id) AS outcomes FROM app GROUP BY 1""")  # fmt: skip
def provenance(spark, sf_dir):
    """The appearances of every actor as JSON, read back."""
    made = sweep.provenance(qo.k_appearances(spark, sf_dir))
    items = F.from_json("provenance", ds.PROVENANCE)
    shown = F.array_join(F.transform(items, lambda x: F.concat_ws(" ", x["outcome_id"], x["asset_id"], x["window"])), ",")
    lead = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["lead_time_days"])
    return made.select("actor", F.size(items).alias("items"), F.unix_micros(items[0]["t0"]).alias("first_t0"), F.round(lead, 2).alias("lead"), shown.alias("outcomes"))


@query(
    "replay_convergence",
    sql.with_(*qs.CONVERGED_PARTS, qs._converged(f"SELECT unnest(range({qo.AS_OF_US - 6 * DAY}, {qo.AS_OF_US + 1}, {DAY})) AS t")).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT asset_id, t AS us, round(least(0.95, 0.4 + 0.15 * independent), 6) AS significance FROM con",
)
def replay_convergence(spark, sf_dir):
    """Convergence of a frozen set of tracked actors over a week of days."""
    events, frozen = adapters.clickstream_events(spark, sf_dir), qo.tracked(spark, sf_dir)
    edges = qg.k_edges(spark, sf_dir, frozen)
    found = sg.first_per_key(sg.convergence(events, frozen, edges, F.col("as_of"), qs.SIGNAL, ticks(spark, "2024-01-19 00:00:00", qo.AS_OF, "1 day")))
    return found.select("asset_id", F.unix_micros("triggered_at").alias("us"), F.round("significance", 6).alias("significance"))


NIGHT = (sql.EVENTS, sql.CANDLES_K, sql.outcomes(qo.K), "o AS (SELECT * FROM oc)", qs.STORED.replace(f">= {10 * DAY}", f">= {21 * DAY}"))


@query(
    "nightly_digest",
    sql.with_(*NIGHT) + "SELECT 'detected' AS section, outcome_class AS key, count(*)::DOUBLE AS value FROM oc GROUP BY 2 UNION ALL SELECT 'grades', grade, count(*) FROM gd GROUP BY 2 "
    "UNION ALL SELECT 'precision', family, round(count(*) FILTER (grade = 'hit') / count(*), 6) FROM gd WHERE grade IN ('hit', 'miss') GROUP BY 2",
)
def nightly_digest(spark, sf_dir):
    """A night that starts from no outcomes and no candidates: what it detects, grades and measures."""
    night = k_night(spark, sf_dir)
    return night.digest.where("section IN ('detected', 'grades', 'precision')").withColumn("value", F.round("value", 6))


def k_night(spark, sf_dir):
    events, candles = adapters.clickstream_events(spark, sf_dir), adapters.clickstream_candles(spark, sf_dir)
    stored = qs.stored(spark, sf_dir).select("signal_id", "family", "asset_id", F.lit(None).cast("string").alias("wallet"), "triggered_at", "significance", F.lit("pending").alias("grade"), F.lit(False).alias("delivered"))
    none = oc.detect_all(candles.limit(0), qo.K)
    empty = spark.createDataFrame([], ds.CANDIDATES)
    return sweep.nightly(
        events, candles, qo.k_assets(spark, sf_dir), none, empty, stored, qo.as_of(), detect=qo.K, discover=qo.K_DISCOVERY, wallets=qw.WALLETS, signal=qs.SIGNAL, graph=qg.GRAPH
    )


@query("nightly_decisions")
def nightly_decisions(spark, sf_dir):
    """What becomes of the night's signals, and the counters of the dispatch."""
    return policy.dispatch_counts(k_night(spark, sf_dir).decisions)
