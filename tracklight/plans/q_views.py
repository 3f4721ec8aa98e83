"""Queries: scans, merges, lists and pages over the driver tables, each held against SQL. Orders are part of the rows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions import tables
from tracklight.operators import backtest as bt
from tracklight.operators import discovery as ds
from tracklight.operators import graph as gr
from tracklight.operators import nightly as nl
from tracklight.operators import outcomes as oc
from tracklight.operators import playbooks as pb
from tracklight.operators import policy, sinks, sweep, views
from tracklight.operators import signals as sg
from tracklight.plans import q_graph as qg
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_signals as qs
from tracklight.plans import q_sources as qx
from tracklight.plans import q_wallets as qw
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAILY_OUTCOMES, DAY, PREDICTIVE
from tracklight.sources import adapters, scans

AT = qo.AS_OF_US


def clicks(spark, sf_dir):
    return adapters.clickstream_events(spark, sf_dir)


def at(us):
    return F.timestamp_micros(F.lit(us))


def ordered(df, *order):
    """The rows of a list with their place in its order, as ``place``."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))  # lists are short


def orders_as_events(spark, sf_dir):
    """Orders of customers as events; those of status P were reverted, and those of status F are seen a day late."""
    status, when = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    return adapters.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.concat(F.lit("c"), "o_custkey").alias("actor"), F.concat(F.lit("p:"), F.substring("o_orderpriority", 1, 1)).alias("asset_id"),
        when.alias("chain_time"), F.when(status == "F", F.timestamp_micros(F.unix_micros(when) + DAY)).otherwise(when).alias("observed_at"), F.when(status == "P", "reverted").otherwise("finalized").alias("finality"),
    )


ORDERS = f"od AS (SELECT o_orderkey::VARCHAR AS event_id, 'c' || o_custkey AS actor, 'p:' || substr(o_orderpriority, 1, 1) AS asset_id, epoch_us(o_orderdate) AS chain, epoch_us(o_orderdate) + CASE WHEN o_orderstatus = 'F' THEN {DAY} ELSE 0 END AS seen, o_orderstatus = 'P' AS reverted FROM orders)"
CUT = 852_076_800_000_000  # 1997-01-01


@query("scan_known_orders", sql.with_(ORDERS) + f"SELECT event_id, actor FROM od WHERE seen <= {CUT} AND NOT reverted")
def scan_known_orders(spark, sf_dir):
    """Late rows count from the moment they were seen, reverted ones never."""
    return scans.observed_events(orders_as_events(spark, sf_dir), at(CUT)).select("event_id", "actor")


@query("scan_with_reverted", sql.with_(ORDERS) + f"SELECT event_id, actor, reverted FROM od WHERE seen >= {CUT} AND seen <= {CUT + 300 * DAY} AND asset_id = 'p:2' UNION ALL SELECT event_id, actor, reverted FROM od WHERE seen >= {CUT} AND seen <= {CUT + 300 * DAY} AND asset_id = 'p:5' AND actor = 'c25'")
def scan_with_reverted(spark, sf_dir):
    """An asset's events, reverted ones among them, and those of one actor on another asset."""
    of = lambda **which: scans.observed_events(orders_as_events(spark, sf_dir), at(CUT + 300 * DAY), since=at(CUT), include_reverted=True, **which)
    return of(asset="p:2").unionByName(of(actor="c25", asset="p:5")).select("event_id", "actor", (F.col("finality") == "reverted").alias("reverted"))


@query("backfill", sql.with_(ORDERS) + f"SELECT event_id FROM od WHERE seen BETWEEN {CUT} AND {CUT + 30 * DAY} AND actor IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def backfill(spark, sf_dir):
    addresses = adapters.read(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("actor"))
    return scans.backfill(orders_as_events(spark, sf_dir), at(CUT), at(CUT + 30 * DAY), addresses).select("event_id")


@query("watched_events", sql.with_(sql.EVENTS) + "SELECT event_id FROM ev WHERE actor IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_nationkey = 3)")
def watched_events(spark, sf_dir):
    some = adapters.read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("actor"))
    return scans.watched(clicks(spark, sf_dir), some.unionByName(some)).select("event_id")


@query("candle_range", sql.with_(sql.CANDLES_K) + f"SELECT s AS us, close FROM cd WHERE asset_id = 'k:7' AND s BETWEEN {AT - 7 * DAY} AND {AT}")
def candle_range(spark, sf_dir):
    return scans.candle_range(adapters.clickstream_candles(spark, sf_dir), "k:7", at(AT - 7 * DAY), at(AT)).select(F.unix_micros("start").alias("us"), "close")


@query("listings_since", sql.with_(sql.EVENTS, sql.LISTINGS) + f"SELECT outcome_id, t0 FROM lst WHERE seen >= {AT - 22 * DAY}")
def listings_since(spark, sf_dir):
    return scans.listings_since(adapters.clickstream_listings(clicks(spark, sf_dir)), at(AT - 22 * DAY)).select("outcome_id", F.unix_micros("t0").alias("t0"))


@query("history", sql.with_(ORDERS) + f"SELECT event_id FROM od WHERE chain BETWEEN {CUT} AND {CUT + 9 * DAY}")
def history(spark, sf_dir):
    return scans.history(orders_as_events(spark, sf_dir), at(CUT), at(CUT + 9 * DAY)).select("event_id")


@query(
    "dead_letter_reasons",
    """SELECT error, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'no event id' WHEN 2 THEN 'no actor' WHEN 3 THEN 'no observation time' WHEN 4 THEN 'unknown event type' WHEN 5 THEN 'unknown finality' WHEN 6 THEN 'negative value' END AS error
FROM lineitem WHERE l_suppkey % 5 = 0) WHERE error IS NOT NULL GROUP BY 1""",
)
def dead_letter_reasons(spark, sf_dir):
    """Rows that lack something each: what is missing depends on the line number."""
    n, bad = F.col("l_linenumber"), F.col("l_suppkey") % 5 == 0
    of = lambda k, broken, value: F.when(bad & (n == k), broken).otherwise(value)
    none = F.lit(None).cast("string")
    rows = adapters.read(spark, sf_dir, "lineitem").select(
        of(1, none, F.col("l_orderkey").cast("string")).alias("event_id"), of(2, F.lit(""), F.col("l_suppkey").cast("string")).alias("actor"), of(3, F.lit(None).cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("observed_at"),
        of(4, F.lit("party"), F.lit("swap")).alias("event_type"), of(5, none, F.lit("finalized")).alias("finality"), of(6, F.lit(-1.0), F.col("l_extendedprice")).alias("usd_value"),
    )
    return sinks.split_dead_letters(rows)[1].groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_counts", sql.with_(qx.DELIVERIES) + """, cut AS (SELECT max(seq) // 2 + min(seq) // 2 AS c FROM gd), st AS (SELECT event_id, arg_max(finality, struct_pack(a := seq, b := finality)) AS was FROM gd, cut WHERE seq < c GROUP BY 1),
bt AS (SELECT event_id, count(*) AS n, arg_max(finality, struct_pack(a := seq, b := finality)) AS finality FROM gd, cut WHERE seq >= c GROUP BY 1)
SELECT sum(n)::BIGINT AS seen, count(*) FILTER (was IS NULL) AS written, sum(n - (was IS NULL)::INT)::BIGINT AS duplicates, count(*) FILTER (finality = 'reverted' AND (was IS NULL OR was <> 'reverted')) AS reverted FROM bt LEFT JOIN st USING (event_id)""")  # fmt: skip
def upsert_counts(spark, sf_dir):
    good = tables.keep(sinks.split_dead_letters(qx.deliveries(spark, sf_dir))[0])
    low, high = good.agg(F.min("seq"), F.max("seq")).first()
    cut = high // 2 + low // 2
    stored = sinks.upsert_events(good.limit(0), good.where(F.col("seq") < cut), "seq")
    return sinks.upsert_counts(stored, good.where(F.col("seq") >= cut), "seq")


@query("register_assets", "SELECT 'part:' || p_partkey AS asset_id, CASE WHEN p_partkey % 3 = 0 THEN 'known' ELSE p_brand END AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN p_partkey * 1000000 ELSE 5000000 END AS first_us FROM part")
def register_assets(spark, sf_dir):
    part, key = adapters.read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.lit("part:"), key.cast("string")).alias("asset_id")
    stored = part.where("p_partkey % 3 = 0").select(name, F.lit("known").alias("symbol"), at(0).alias("first_seen_at"))
    pools = part.select(name, F.col("p_brand").alias("symbol"), F.when(key % 2 == 0, F.timestamp_micros(key * 1_000_000)).alias("created_at"), at(5_000_000).alias("first_candle"))
    return sinks.register_assets(stored, pools.unionByName(pools)).select("asset_id", "symbol", F.unix_micros("first_seen_at").alias("first_us"))


@query("above_floors", "SELECT 'part:' || p_partkey AS asset_id FROM part WHERE p_retailprice >= 910 AND p_size % 5 <> 0 AND p_size >= 10")
def above_floors(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part")
    universe = part.select(F.concat(F.lit("part:"), "p_partkey").alias("asset_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")).alias("liquidity_usd"), F.col("p_retailprice").alias("volume_24h"))
    return sinks.above_floors(universe, liquidity=10.0, volume=910.0).select("asset_id")


@query("appended_reports", "SELECT n_regionkey AS key, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey > 12) GROUP BY 1")
def appended_reports(spark, sf_dir):
    path, nation = tables.new_path(spark, "reports"), adapters.read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    sinks.append(nation, path)
    sinks.append(nation.where("n_nationkey > 12"), path)
    return spark.read.parquet(path).groupBy(F.col("n_regionkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("total"))


@query("upsert_edges", sql.with_(*qg.EDGE_PARTS) + "SELECT source, target, edge_type, CASE WHEN edge_type = 'leads' THEN observations ELSE 99 END AS observations FROM ed UNION ALL SELECT 'x', 'y', 'leads', 1")
def upsert_edges(spark, sf_dir):
    found = qg.k_edges(spark, sf_dir).select("source", "target", "edge_type", "observations")
    other = spark.createDataFrame([("x", "y", "leads", 1)], found.schema)
    stored = found.withColumn("observations", F.lit(99).cast("long")).unionByName(other)
    return gr.upsert_edges(stored, found.where("edge_type = 'leads'"))


@query("edge_modes", sql.with_(*qg.EDGE_PARTS) + f"""SELECT source, target, CASE edge_type WHEN 'leads' THEN '{";".join(gr.FALSE_POSITIVES["leads"])}' ELSE '{";".join(gr.FALSE_POSITIVES["co_acquired"])}' END AS modes,
(SELECT string_agg(asset_id, ',' ORDER BY asset_id) FROM (SELECT a.asset_id FROM fe a JOIN fe b ON a.asset_id = b.asset_id WHERE a.actor = ed.source AND b.actor = ed.target AND (a.f < b.f OR (a.f = b.f AND a.actor < b.actor)) AND b.f - a.f <= {2 * DAY} ORDER BY 1 LIMIT 20)) AS assets FROM ed""")  # fmt: skip
def edge_modes(spark, sf_dir):
    """What else may explain each edge, and the assets that speak for it."""
    return qg.k_edges(spark, sf_dir).select("source", "target", F.array_join("false_positive_modes", ";").alias("modes"), F.array_join("shared_assets", ",").alias("assets"))


@query("entity_of_wallets", sql.with_(qg.MEMBERS) + f"SELECT wallet, arg_max(entity_id, struct_pack(a := valid_from, b := entity_id)) AS entity_id FROM (SELECT * FROM mem UNION ALL SELECT 'other', wallet, is_primary, valid_from + {DAY}, NULL FROM mem WHERE wallet LIKE '%1') WHERE valid_from <= {AT} AND (valid_to IS NULL OR valid_to > {AT}) GROUP BY 1")
def entity_of_wallets(spark, sf_dir):
    members = qg.members(spark, sf_dir)
    later = members.where(F.col("wallet").endswith("1")).select(F.lit("other").alias("entity_id"), "wallet", "is_primary", F.timestamp_micros(F.unix_micros("valid_from") + DAY).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return gr.entity_of_wallets(members.unionByName(later), qo.as_of())


@query(
    "acquisition_kinds",
    sql.with_(sql.EVENTS) + """SELECT event_type, coalesce(side, '') AS side, count(*) FILTER ((event_type = 'swap' AND coalesce(side = 'buy', false)) OR (event_type IN ('position_opened', 'position_increased') AND coalesce(side = 'long', false))) AS acquisitions,
count(*) FILTER (event_type IN ('order_placed', 'order_cancelled')) AS intents FROM ev GROUP BY 1, 2""",
)
def acquisition_kinds(spark, sf_dir):
    kind, side = F.col("event_type"), F.col("side")
    return clicks(spark, sf_dir).groupBy(kind, F.coalesce(side, F.lit("")).alias("side")).agg(F.count_if(fn.is_acquisition(kind, side)).alias("acquisitions"), F.count_if(fn.is_intent_only(kind)).alias("intents"))


@query("score_intervals", sql.with_(*qw.SCORE_PARTS, qw.SCORES) + """, n AS (SELECT actor, hits, greatest(touched, hits)::DOUBLE AS n, hits / greatest(touched, hits) AS p FROM sc)
SELECT actor, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS lo, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS hi FROM n""")  # fmt: skip
def score_intervals(spark, sf_dir):
    return qw.k_scores(spark, sf_dir).select("actor", F.round("interval.lo", 6).alias("lo"), F.round("interval.hi", 6).alias("hi"))


@query("exact_amounts", """SELECT p_partkey, (p_partkey * 1000000007 + p_size)::VARCHAR AS raw, p_size % 19 AS decimals,
  trim(TRAILING '.' FROM left(lpad((p_partkey * 1000000007 + p_size)::VARCHAR, 40, '0'), 40 - p_size % 19)::HUGEINT::VARCHAR || '.' || right(lpad((p_partkey * 1000000007 + p_size)::VARCHAR, 40, '0'), p_size % 19)) AS shown,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice::DECIMAL(18, 2)::DOUBLE END AS price, epoch_us(TIMESTAMP '2024-01-01') + p_partkey * 1001 AS us FROM part""")
def exact_amounts(spark, sf_dir):
    """Amounts keep every digit through scaling and back; texts that are no numbers are null; times keep theirs through text and back."""
    key = F.col("p_partkey")
    raw, decimals = (key * 1_000_000_007 + F.col("p_size")).cast("decimal(38,0)"), F.col("p_size") % 19
    price = F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    back = fn.unscale_amount(fn.scale_amount(raw, decimals), decimals)
    time = fn.parse_utc(fn.iso(F.timestamp_micros(F.lit(1_704_067_200_000_000) + key * 1001)))
    return adapters.read(spark, sf_dir, "part").select("p_partkey", back.cast("string").alias("raw"), decimals.alias("decimals"), fn.scaled_text(raw, decimals).alias("shown"), fn.to_decimal(price).cast("double").alias("price"), F.unix_micros(time).alias("us"))


STORED_LIST = "lst2 AS (SELECT signal_id, family, asset_id, us, significance FROM ss)"


def stored(spark, sf_dir):
    return qs.graded(spark, sf_dir).withColumn("title", F.col("signal_id"))


@query("signal_list", sql.with_(*qs.GRADE_PARTS) + "SELECT signal_id, row_number() OVER (ORDER BY us DESC, significance DESC, signal_id) AS place FROM ss WHERE significance >= 0.4 AND family <> 'silent_accumulation' ORDER BY us DESC, significance DESC, signal_id LIMIT 50")
def signal_list(spark, sf_dir):
    found = views.signal_list(stored(spark, sf_dir), min_significance=0.4, alertable=True)
    return ordered(found, F.desc("triggered_at"), F.desc("significance"), "title").select("signal_id", "place")


@query("signal_list_family", sql.with_(*qs.GRADE_PARTS) + "SELECT signal_id FROM ss WHERE family = 'silent_accumulation' ORDER BY us DESC, significance DESC, signal_id LIMIT 20")
def signal_list_family(spark, sf_dir):
    return views.signal_list(stored(spark, sf_dir), family="silent_accumulation", limit=20).select("signal_id")


@query("muted_total", sql.with_(*qs.GRADE_PARTS) + "SELECT count(*) FILTER (family = 'silent_accumulation') AS muted_total FROM ss")
def muted_total(spark, sf_dir):
    return views.muted_total(stored(spark, sf_dir))


@query("candidate_list", sql.with_(qw.CAND) + "SELECT wallet, row_number() OVER (ORDER BY edge DESC, wallet) AS place FROM cand WHERE status = 'shadow' ORDER BY edge DESC, wallet LIMIT 100")
def candidate_list(spark, sf_dir):
    return ordered(views.candidate_list(qw.candidates_of_customers(spark, sf_dir), "shadow"), F.desc("edge_vs_base"), "wallet").select("wallet", "place")


@query("radar", sql.with_(qw.CAND) + "SELECT wallet, row_number() OVER (ORDER BY edge DESC, wallet) AS place FROM cand WHERE status IN ('shadow', 'tracked')")
def radar(spark, sf_dir):
    return ordered(views.radar(qw.candidates_of_customers(spark, sf_dir)), F.desc("edge_vs_base"), "wallet").select("wallet", "place")


@query("top_universe", "SELECT 'part:' || p_partkey AS asset_id FROM part ORDER BY CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_retailprice END DESC NULLS LAST, asset_id LIMIT 150")
def top_universe(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part")
    universe = part.select(F.concat(F.lit("part:"), "p_partkey").alias("asset_id"), F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("volume_24h"))
    return views.top_universe(universe, 150).select("asset_id")


@query("latest_orders", "SELECT epoch_us(o_orderdate) * 1000 + o_orderkey % 1000 AS at FROM orders ORDER BY 1 DESC LIMIT 50")
def latest_orders(spark, sf_dir):
    rows = adapters.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey") % 1000).alias("at"))
    return sweep.latest(rows, "at").select("at")


@query("discovery_report", sql.with_(*qw.SCORE_PARTS, qw.SCORES, qw.REJECT) + "SELECT actor, reason IS NULL AS passed, hits, round(edge_ratio, 6) AS edge_ratio, row_number() OVER (ORDER BY reason IS NULL DESC, edge_ratio DESC, actor) AS place FROM rej WHERE reason IS NULL OR hits >= 2")
def discovery_report(spark, sf_dir):
    found = views.discovery_report(qw.k_scores(spark, sf_dir))
    return ordered(found, F.desc("passed"), F.desc("edge_ratio"), "actor").select("actor", "passed", "hits", F.round("edge_ratio", 6).alias("edge_ratio"), "place")


@query(
    "wallet_profile",
    sql.with_(*qo.BASE, qw.SEEN, qw.ACTIVITY, qw.PRECISION, qw.ARCHETYPE, qo.APPEARANCES, qo.TRACKED)
    + f"SELECT a.actor, a.archetype, total_actions, CASE WHEN tr.wallet IS NULL THEN NULL ELSE 'tracked' END AS status, least(100, total_actions) AS n_last_events, (SELECT event_id FROM e WHERE actor = a.actor ORDER BY us DESC, event_id LIMIT 1) AS newest FROM arch a LEFT JOIN tr ON wallet = a.actor WHERE a.actor = '1'",
)
def wallet_profile(spark, sf_dir):
    found = views.wallet_profile(qw.k_metrics(spark, sf_dir), qo.tracked(spark, sf_dir), clicks(spark, sf_dir), "1", qo.as_of())
    return found.select("actor", "archetype", "total_actions", "status", F.size("last_events").cast("long").alias("n_last_events"), F.col("last_events")[0]["event_id"].alias("newest"))


@query(
    "today_feed",
    sql.with_(*qo.TRACKED_PARTS, qs.ACTIONS)
    + """, r AS (SELECT event_type = 'order_placed' AND NOT filled AS open, asset_id, actor AS wallet, sig, concat(archetype, ' wallet ', substr(actor, 1, 8), '… ', CASE WHEN event_type = 'order_placed' AND NOT filled THEN 'placed a resting order on' ELSE coalesce(side, 'acted on') END, ' ', coalesce(asset_id, 'unknown asset')) AS title FROM act_s WHERE sig >= 0.25)
SELECT asset_id, wallet, title, round(sig, 6) AS significance, open FROM r ORDER BY open DESC, sig DESC, title LIMIT 20""",
)
def today_feed(spark, sf_dir):
    signals = qs.k_actions(spark, sf_dir).withColumn("open", F.col("family") == "resting_order_placed")
    return views.today_feed(signals).select("asset_id", "wallet", "title", F.round("significance", 6).alias("significance"), "open")


@query("alert_text", "SELECT page_id, trim(replace(replace(url, 'http', 'hxxp'), chr(10), ' ')) AS alert_title, CASE page_id % 3 WHEN 0 THEN 'No supporting facts recorded' WHEN 1 THEN 'a hxxp | b | c' ELSE 'one' END AS alert_body FROM pages")
def alert_text(spark, sf_dir):
    """Facts: none, four of which three are told, or one."""
    key = F.col("page_id") % 3
    facts = F.when(key == 0, F.array().cast("array<string>")).when(key == 1, F.array(*map(F.lit, ("a http", "b", "c", "d")))).otherwise(F.array(F.lit("one")))
    return policy.alert_text(adapters.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), facts.alias("supporting_facts"))).select("page_id", "alert_title", "alert_body")


@query("quiet_hours", sql.with_(sql.EVENTS) + "SELECT event_id, us // 3600000000 % 24 >= 22 OR us // 3600000000 % 24 < 6 AS night, us // 3600000000 % 24 >= 9 AND us // 3600000000 % 24 < 17 AS day, CASE WHEN event_type = 'swap' THEN 'critical' WHEN event_type = 'liquidation' THEN 'elevated' ELSE 'normal' END AS band FROM ev")
def quiet_hours(spark, sf_dir):
    """Quiet hours over midnight and within a day, and the risk band."""
    kind = F.col("event_type")
    family = F.when(kind == "swap", "pump_operator_activity").otherwise("other")
    risks = F.when(kind == "liquidation", F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    when = F.col("observed_at")
    return clicks(spark, sf_dir).select("event_id", fn.in_quiet_hours(when, 22, 6).alias("night"), fn.in_quiet_hours(when, 9, 17).alias("day"), fn.risk_band(family, risks).alias("band"))


@query("apply_decisions", "SELECT c_custkey AS proposal_id, CASE WHEN c_custkey % 3 = 0 THEN 'applied' WHEN c_custkey % 5 = 0 THEN 'approved' WHEN c_custkey % 2 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM customer")
def apply_decisions(spark, sf_dir):
    """The last decision counts, and only for pending proposals."""
    key, customer = F.col("c_custkey"), adapters.read(spark, sf_dir, "customer")
    proposals = customer.select(key.alias("proposal_id"), F.when(key % 3 == 0, "applied").otherwise("pending").alias("status"))
    first = customer.where("c_custkey % 2 = 0 OR c_custkey % 5 = 0").select(key.alias("proposal_id"), F.lit("rejected").alias("decision"), F.lit("a").alias("by"), at(1).alias("at"))
    second = customer.where("c_custkey % 5 = 0").select(key.alias("proposal_id"), F.lit("approved").alias("decision"), F.lit("b").alias("by"), at(2).alias("at"))
    return nl.apply_decisions(proposals, first.unionByName(second))


@query("stage_base_rates", sql.with_(*qg.SEQ_PARTS) + "SELECT entity_id, count(*) FILTER (completed) AS completed, count(*) FILTER (completed) + count(*) FILTER (aborted) AS total FROM sq GROUP BY 1 HAVING count(*) FILTER (completed) >= 3")
def stage_base_rates(spark, sf_dir):
    return pb.stage_base_rates(pb.playbooks(qg.k_sequences(spark, sf_dir), qg.PLAYBOOK))


@query("paper_positions", sql.with_(*qs.FILL_PARTS) + "SELECT entry_id, round(CASE WHEN p > 0 THEN p * 1.015 END, 6) AS fill_price, row_number() OVER (ORDER BY us DESC, entry_id) AS place FROM fl")
def paper_positions(spark, sf_dir):
    found = bt.paper_positions(qs.entries(spark, sf_dir), adapters.clickstream_candles(spark, sf_dir), qs.BACKTEST)
    return ordered(found, F.desc("signal_at"), "entry_id").select("entry_id", F.round("fill_price", 6).alias("fill_price"), "place")


@query("signal_order", sql.with_(*qo.TRACKED_PARTS, qs.ACTIONS) + f"SELECT wallet, us, row_number() OVER (ORDER BY sig DESC, us, family, asset_id NULLS FIRST, wallet) AS place FROM (SELECT CASE WHEN event_type = 'order_placed' AND NOT filled THEN 'resting_order_placed' ELSE 'tracked_entity_action' END AS family, asset_id, actor AS wallet, us, sig FROM act_s WHERE sig >= 0.25)")
def signal_order(spark, sf_dir):
    """The most significant first; the place is taken from the list as it comes."""
    signals = sg.union(qs.k_actions(spark, sf_dir))
    placed = tables.dense_index(signals, [F.desc("significance"), F.col("triggered_at"), F.col("family"), F.col("asset_id"), F.col("wallet")], "place")
    return placed.select("wallet", F.unix_micros("triggered_at").alias("us"), (F.col("place") + 1).alias("place"))


@query("silent_evidence", sql.with_(sql.EVENTS, qs._silent(f"SELECT {AT} AS t")) + f"SELECT sil.asset_id, (SELECT string_agg(event_id, ',' ORDER BY us, event_id) FROM (SELECT * FROM ev WHERE ev.asset_id = sil.asset_id AND us <= {AT} AND us >= {AT - 14 * DAY} AND side = 'buy' ORDER BY us, event_id LIMIT 20)) AS evidence FROM sil")
def silent_evidence(spark, sf_dir):
    """The first twenty events that speak for each quiet accumulation."""
    clock = spark.range(1).select(qo.as_of().alias("as_of"))
    return sg.silent_accumulation(clicks(spark, sf_dir), clock, qs.SIGNAL).select("asset_id", F.array_join("evidence_ids", ",").alias("evidence"))


@query("volume_7", sql.with_(sql.CANDLES_PART) + "SELECT asset_id, s AS us, round(sum(volume) OVER (PARTITION BY asset_id ORDER BY s ROWS 6 PRECEDING), 4) AS v7, round(sum(volume) OVER (PARTITION BY asset_id ORDER BY s ROWS 24 PRECEDING), 4) AS v25 FROM cd")
def volume_7(spark, sf_dir):
    candles = adapters.market_candles(spark, sf_dir)
    found = views.trailing_volume(views.trailing_volume(candles, 7).withColumnRenamed("trailing_volume", "v7"), 25)
    return found.select("asset_id", F.unix_micros("start").alias("us"), F.round("v7", 4).alias("v7"), F.round("trailing_volume", 4).alias("v25"))


@query("brand_candles", f"SELECT 'brand:' || p_brand AS asset_id, (epoch_us(l_shipdate) // {DAY}) * {DAY} AS us, median(l_extendedprice / l_quantity) AS close, round(sum(l_extendedprice), 2) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def brand_candles(spark, sf_dir):
    return adapters.brand_candles(spark, sf_dir).select("asset_id", F.unix_micros("start").alias("us"), "close", F.round("volume", 2).alias("volume"))


DAILY = dataclasses.replace(qo.PART, run_least_volume=DAILY_OUTCOMES.run_least_volume, dormant_most_volume=DAILY_OUTCOMES.dormant_most_volume)


@query("detect_daily", sql.with_(sql.CANDLES_PART, sql.outcomes(DAILY)) + "SELECT outcome_class, asset_id, t0 FROM oc")
def detect_daily(spark, sf_dir):
    """The volume floors of daily candles, over the market's."""
    return oc.detect_all(adapters.market_candles(spark, sf_dir), DAILY).select("outcome_class", "asset_id", F.unix_micros("t0").alias("t0"))




@query("survival", "SELECT count(*) FILTER (a AND b) AS kept, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b AND NOT a) AS gained, round(count(*) FILTER (a AND b) / count(*) FILTER (a), 6) AS survival_rate FROM (SELECT c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b FROM customer)")
def survival(spark, sf_dir):
    customer = adapters.read(spark, sf_dir, "customer")
    of = lambda n: customer.select(F.col("c_custkey").alias("actor"), (F.col("c_custkey") % n == 0).alias("passed"))
    return qw.rounded(ds.survival(of(2), of(3)))


@query(
    "backtest_run",
    sql.with_(*qs.FILL_PARTS, sql.outcomes(qo.K), sql.LISTINGS, qo.ALL_OUTCOMES, sql.ASSETS)
    + f"""SELECT 'trades' AS check_name, true AS passed, count(*) AS bad FROM rt UNION ALL SELECT 'rejected', true, count(*) FROM fl WHERE NOT coalesce(p > 0, false)
UNION ALL SELECT 'outcome_first_observed_at_not_before_t0', count(*) FILTER (seen < t0) = 0, count(*) FILTER (seen < t0) FROM o UNION ALL SELECT 'event_observed_at_not_before_chain_time', true, 0
UNION ALL SELECT 'universe_includes_non_performers', n > 0 AND w < 0.5 * n, w FROM (SELECT count(DISTINCT asset_id) FILTER (outcome_class IN {PREDICTIVE}) AS w FROM o), (SELECT count(*) FILTER (first_seen <= {AT}) AS n FROM ast)
UNION ALL SELECT 'observation_lag_recorded', true, 0""",
)
def backtest_run(spark, sf_dir):
    """A run with its audit; on this stream most assets moved, so the audit rightly objects to the universe."""
    events = clicks(spark, sf_dir)
    found = bt.run(qs.entries(spark, sf_dir), adapters.clickstream_candles(spark, sf_dir), events, qo.k_outcomes(spark, sf_dir), qo.k_assets(spark, sf_dir), qo.as_of(), qs.BACKTEST)
    counts = found.summary.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(True).alias("passed"), F.col(n).alias("bad")) for n in ("trades", "rejected")])).alias("c")).select("c.*")
    return counts.unionByName(found.audit)
