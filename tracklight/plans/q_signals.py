"""Queries: signal families, alert decisions, grading, proposals, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.temporal import ticks
from tracklight.operators import backtest as bt
from tracklight.operators import metrics as wm
from tracklight.operators import nightly as nl
from tracklight.operators import outcomes as oc
from tracklight.operators import policy
from tracklight.operators import signals as sg
from tracklight.operators.graph import FALSE_POSITIVES
from tracklight.plans import q_graph as qg
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_wallets as qw
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY, PREDICTIVE, SIGNAL_TEXTS, AlertConfig, BacktestConfig, SignalConfig
from tracklight.sources import adapters

AT = qo.AS_OF_US
SIGNAL = SignalConfig(silent_move=0.5)
BACKTEST = BacktestConfig(hold_days=3)

TRACKED_PARTS, tracked = qo.TRACKED_PARTS, qo.tracked


def clicks(spark, sf_dir):
    return adapters.clickstream_events(spark, sf_dir)


def brief(signals):
    return signals.select("family", "asset_id", "wallet", F.unix_micros("triggered_at").alias("us"), F.round("significance", 6).alias("significance"))


ACTIONS = f"""
own AS (SELECT ev.*, edge, archetype FROM ev JOIN tr ON wallet = actor WHERE us <= {AT}),
prv AS (SELECT *, max(us) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM own),
rate_m AS (SELECT actor, count(*) / (greatest((max(us) - min(us)) / {DAY}.0, 1.0) / 30.44) AS tpm FROM own GROUP BY 1),
rec AS (SELECT prv.*, tpm, (SELECT count(*) FROM own o WHERE o.actor = prv.actor AND o.usd_value <= prv.usd_value) / (SELECT count(o.usd_value) FROM own o WHERE o.actor = prv.actor) AS pct FROM prv JOIN rate_m USING (actor) WHERE us >= {AT - 3 * DAY}),
act_s AS (
  SELECT *, least(1.0, coalesce(0.35 * pct, 0) + coalesce(0.3 * least((us - prev) / {DAY}.0 / 60, 1.0), 0) + CASE WHEN event_type IN ('order_placed', 'position_opened', 'liquidation') THEN 0.2 ELSE 0 END + CASE WHEN tpm <= 6 THEN 0.15 ELSE 0 END) AS sig FROM rec
)"""
ACTION_ROWS = "SELECT CASE WHEN event_type = 'order_placed' AND NOT filled THEN 'resting_order_placed' ELSE 'tracked_entity_action' END AS family, asset_id, actor AS wallet, us, round(sig, 6) AS significance FROM act_s WHERE sig >= 0.25"


def k_actions(spark, sf_dir, candidates=None):
    events = clicks(spark, sf_dir)
    candidates = tracked(spark, sf_dir) if candidates is None else candidates
    seen = wm.visible(events, qo.as_of()).join(candidates.select(F.col("wallet").alias("actor")), "actor", "left_semi")
    return sg.tracked_actions(events, candidates, wm.activity(seen), qo.as_of(), SIGNAL)


@query("sig_tracked_action", sql.with_(*TRACKED_PARTS, ACTIONS) + f"SELECT * FROM ({ACTION_ROWS}) WHERE family = 'tracked_entity_action'")
def sig_tracked_action(spark, sf_dir):
    return brief(k_actions(spark, sf_dir).where("family = 'tracked_entity_action'"))


@query("sig_resting", sql.with_(*TRACKED_PARTS, ACTIONS) + f"SELECT * FROM ({ACTION_ROWS}) WHERE family = 'resting_order_placed'")
def sig_resting(spark, sf_dir):
    return brief(k_actions(spark, sf_dir).where("family = 'resting_order_placed'"))


def _silent(tick_rows: str) -> str:
    return f"""
tk AS ({tick_rows}), sb AS (
  SELECT t, asset_id, count(DISTINCT actor) AS buyers, arg_min(usd_value, struct_pack(a := us, b := event_id)) AS p0, arg_max(usd_value, struct_pack(a := us, b := event_id)) AS p1, count(usd_value) AS np,
    sum(coalesce(usd_value, 0)) AS net, max(us) AS last_us
  FROM tk JOIN ev ON us <= t AND us >= t - {14 * DAY} WHERE side = 'buy' AND asset_id IS NOT NULL GROUP BY 1, 2
), sil AS (
  SELECT * FROM sb WHERE buyers >= 3 AND (np < 2 OR CASE WHEN p0 <> 0 THEN abs(p1 - p0) / p0 ELSE 0 END <= 0.5) AND net > 0
)"""


@query("sig_silent", sql.with_(sql.EVENTS, _silent(f"SELECT {AT} AS t")) + "SELECT asset_id, last_us AS us, round(least(0.9, 0.3 + 0.1 * buyers), 6) AS significance FROM sil")
def sig_silent(spark, sf_dir):
    clock = spark.range(1).select(qo.as_of().alias("as_of"))
    return brief(sg.silent_accumulation(clicks(spark, sf_dir), clock, SIGNAL)).select("asset_id", "us", "significance")


@query(
    "replay_signals",
    sql.with_(sql.EVENTS, _silent(f"SELECT unnest(range({AT - 19 * DAY}, {AT + 1}, {DAY})) AS t"))
    + f"SELECT asset_id, us_day, min(t) AS first_tick FROM (SELECT asset_id, t, last_us // {DAY} AS us_day FROM sil) GROUP BY 1, 2",
)
def replay_signals(spark, sf_dir):
    clock = ticks(spark, "2024-01-06 00:00:00", qo.AS_OF, "1 day")
    found = sg.first_per_key(sg.silent_accumulation(clicks(spark, sf_dir), clock, SIGNAL))
    return found.select("asset_id", F.floor(F.unix_micros("triggered_at") / DAY).alias("us_day"), F.unix_micros("evidence_cutoff").alias("first_tick"))


def _converged(tick_rows: str) -> str:
    return f"""
ct AS ({tick_rows}),
cv0 AS (SELECT t, asset_id, actor, row_number() OVER (PARTITION BY t, asset_id ORDER BY actor) AS i, count(*) OVER (PARTITION BY t, asset_id) AS n
  FROM (SELECT DISTINCT t, asset_id, actor FROM ct JOIN ev ON us <= t AND us >= t - {5 * DAY} SEMI JOIN tr ON wallet = actor WHERE side IN ('buy', 'long') AND asset_id IS NOT NULL)),
rl AS (SELECT actor, list(other) AS others FROM (SELECT source AS actor, target AS other FROM ed UNION SELECT target, source FROM ed) GROUP BY 1),
cv AS (SELECT cv0.*, coalesce(others, []::VARCHAR[]) AS others FROM cv0 LEFT JOIN rl USING (actor)),
fold(t, asset_id, i, n, chosen) AS (
  SELECT t, asset_id, 1::BIGINT, n, [actor] FROM cv WHERE i = 1
  UNION ALL SELECT f.t, f.asset_id, f.i + 1, f.n, CASE WHEN list_has_any(f.chosen, c.others) THEN f.chosen ELSE list_append(f.chosen, c.actor) END FROM fold f JOIN cv c ON c.t = f.t AND c.asset_id = f.asset_id AND c.i = f.i + 1
), con AS (SELECT t, asset_id, n AS wallets, len(chosen) AS independent FROM fold WHERE i = n AND n >= 2 AND len(chosen) >= 2)"""


CONVERGED = _converged(f"SELECT {AT} AS t")
CONVERGED_PARTS = (*TRACKED_PARTS, qg.FIRST, qg.EDGES)


@query("sig_convergence", sql.with_(*CONVERGED_PARTS, CONVERGED).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT 'independent_convergence' AS family, asset_id, NULL::VARCHAR AS wallet, {AT} AS us, round(least(0.95, 0.4 + 0.15 * independent), 6) AS significance FROM con")
def sig_convergence(spark, sf_dir):
    candidates = tracked(spark, sf_dir)
    return brief(sg.convergence(clicks(spark, sf_dir), candidates, qg.k_edges(spark, sf_dir, candidates), qo.as_of(), SIGNAL))


SEQUENCED = f"""
aq AS (SELECT * FROM ev WHERE us <= {AT} AND side IN ('buy', 'long')), pr AS (
  SELECT ed.source, ed.target, l.event_id AS le, l.asset_id, l.us AS lus, median_lag_seconds, ordering_consistency, confidence, observations, min(f.us) AS fus
  FROM ed JOIN aq l ON l.actor = ed.source AND l.us >= {AT - 14 * DAY} JOIN aq f ON f.actor = ed.target AND f.asset_id IS NOT DISTINCT FROM l.asset_id AND f.us > l.us
  WHERE edge_type = 'leads' AND median_lag_seconds > 0 GROUP BY ALL
), seq AS (SELECT asset_id, target AS wallet, fus AS us, round(least(0.95, ordering_consistency + 0.2), 6) AS significance FROM pr WHERE (fus - lus) / 1e6 <= 2 * median_lag_seconds)"""


@query("sig_sequence", sql.with_(*CONVERGED_PARTS, SEQUENCED) + "SELECT * FROM seq")
def sig_sequence(spark, sf_dir):
    return brief(sg.sequence_confirmation(clicks(spark, sf_dir), qg.k_edges(spark, sf_dir), qo.as_of(), SIGNAL)).drop("family")


HISTORY = f"""
oh AS (
  SELECT actor, count(DISTINCT asset_id) AS episodes, count(DISTINCT asset_id) FILTER (asset_id IN (SELECT asset_id FROM o WHERE outcome_class = 'rug_or_collapse' AND seen <= {AT})) AS collapsed
  FROM e JOIN tr ON wallet = actor WHERE archetype = 'pump_operator' AND asset_id IS NOT NULL GROUP BY 1
), hh AS (SELECT actor, median(hours) AS mh FROM hold GROUP BY 1)"""


@query(
    "sig_pump_operator",
    sql.with_(*TRACKED_PARTS, qw.SEEN, qw.HOLD, HISTORY)
    + f"SELECT e.asset_id, e.actor AS wallet, us, episodes || ' prior episodes observed' AS fact, collapsed || ' of ' || episodes || ' prior assets subsequently collapsed' AS record FROM e JOIN oh USING (actor) LEFT JOIN hh USING (actor) WHERE side = 'buy' AND us >= {AT - 3 * DAY}",
)
def sig_pump_operator(spark, sf_dir):
    found = sg.pump_operator_activity(clicks(spark, sf_dir), tracked(spark, sf_dir), qo.k_outcomes(spark, sf_dir), qo.as_of(), SIGNAL)
    return found.select("asset_id", "wallet", F.unix_micros("triggered_at").alias("us"), F.col("supporting_facts")[0].alias("fact"), F.col("supporting_facts")[2].alias("record"))


@query("sig_new_candidate", sql.with_(*TRACKED_PARTS) + f"SELECT wallet, surfaced AS us, round(least(0.8, edge / 10), 6) AS significance FROM tr WHERE surfaced <= {AT} AND surfaced >= {AT - 10 * DAY}")
def sig_new_candidate(spark, sf_dir):
    return brief(sg.new_candidates(tracked(spark, sf_dir), qo.as_of(), F.timestamp_micros(F.lit(AT - 10 * DAY)))).select("wallet", "us", "significance")


def all_signals(spark, sf_dir):
    candidates = tracked(spark, sf_dir)
    start = F.timestamp_micros(F.lit(AT - 10 * DAY))
    return sg.run_all(clicks(spark, sf_dir), candidates, qg.k_edges(spark, sf_dir, candidates), qo.k_outcomes(spark, sf_dir), qo.as_of(), start, SIGNAL)


ALL_ROWS = f"""
SELECT * FROM ({ACTION_ROWS}) UNION ALL SELECT 'silent_accumulation', asset_id, NULL, last_us, round(least(0.9, 0.3 + 0.1 * buyers), 6) FROM sil
UNION ALL SELECT 'independent_convergence', asset_id, NULL, {AT}, round(least(0.95, 0.4 + 0.15 * independent), 6) FROM con UNION ALL SELECT 'sequence_confirmation', asset_id, wallet, us, significance FROM seq
UNION ALL SELECT 'pump_operator_activity', e.asset_id, e.actor, us, 0.6 FROM e JOIN oh USING (actor) WHERE side = 'buy' AND us >= {AT - 3 * DAY}
UNION ALL SELECT 'newly_surfaced_candidate', NULL, wallet, surfaced, round(least(0.8, edge / 10), 6) FROM tr WHERE surfaced <= {AT} AND surfaced >= {AT - 10 * DAY}"""


@query("run_all_signals", sql.with_(*CONVERGED_PARTS, qw.SEEN, qw.HOLD, HISTORY, ACTIONS, _silent(f"SELECT {AT} AS t"), SEQUENCED, CONVERGED).replace("WITH ", "WITH RECURSIVE ", 1) + ALL_ROWS)
def run_all_signals(spark, sf_dir):
    return brief(all_signals(spark, sf_dir))


def _said(key: str, *values: str) -> str:
    """SQL of a text of ``SIGNAL_TEXTS`` with its values."""
    return f"printf('{SIGNAL_TEXTS[key].replace(chr(39), chr(39) * 2)}'{''.join(', ' + v for v in values)})"


ACTOR = "substr(actor, 1, 8)"
TEXT_ROWS = f"""
SELECT CASE WHEN resting THEN 'resting_order_placed' ELSE 'tracked_entity_action' END AS family, asset_id, actor AS wallet, us, NULL::VARCHAR AS fact, round(coalesce(usd_value, 0) + coalesce((us - prev) / {DAY}.0, 0) + filled::INT + 1, 3) AS features, CASE WHEN resting THEN {_said("action_risk")} ELSE '' END AS risks, {_said("action_unknown")} AS unknowns,
  {_said("action_title", "archetype", ACTOR, f"CASE WHEN resting THEN '{SIGNAL_TEXTS['action_resting']}' ELSE coalesce(side, '{SIGNAL_TEXTS['action_other']}') END", "coalesce(asset_id, 'unknown asset')")} AS title
FROM (SELECT *, event_type = 'order_placed' AND NOT filled AS resting FROM act_s WHERE sig >= 0.25)
UNION ALL SELECT 'silent_accumulation', asset_id, NULL, last_us, printf('{SIGNAL_TEXTS["silent_buyers"].format(days=SIGNAL.silent_days)}', buyers), round(buyers + net, 3), {_said("silent_risk")}, {_said("silent_unknown")}, {_said("silent_title", "asset_id", "buyers")} FROM sil
UNION ALL SELECT 'independent_convergence', asset_id, NULL, {AT}, {_said("convergence_fact", "independent", "wallets")}, wallets + independent, {_said("convergence_risk")}, {_said("convergence_unknown")}, {_said("convergence_title", "independent", "asset_id")} FROM con
UNION ALL SELECT 'sequence_confirmation', asset_id, target, fus, {_said("sequence_lag", "(fus - lus) / 1e6 / 3600", "median_lag_seconds / 3600")}, round((fus - lus) / 1e6 + median_lag_seconds + observations, 3), {_said("sequence_risk")}, '{" | ".join(FALSE_POSITIVES["leads"])}', {_said("sequence_title", "substr(target, 1, 8)", "substr(source, 1, 8)", "asset_id")}
  FROM pr WHERE (fus - lus) / 1e6 <= 2 * median_lag_seconds
UNION ALL SELECT 'pump_operator_activity', e.asset_id, e.actor, us, {_said("operator_episodes", "episodes")}, round(episodes + collapsed + coalesce(mh, 0), 3), {_said("operator_exit")} || ' | ' || {_said("operator_past")}, {_said("operator_unknown")}, {_said("operator_title", "substr(e.actor, 1, 8)", "e.asset_id")}
  FROM e JOIN oh USING (actor) LEFT JOIN hh USING (actor) WHERE side = 'buy' AND us >= {AT - 3 * DAY}
UNION ALL SELECT 'newly_surfaced_candidate', NULL, wallet, surfaced, {_said("candidate_edge", "edge")}, 0, {_said("candidate_risk")}, {_said("candidate_unknown")}, {_said("candidate_title", "substr(wallet, 1, 8)", "archetype")} FROM tr WHERE surfaced <= {AT} AND surfaced >= {AT - 10 * DAY}"""


@query("signal_texts", sql.with_(*CONVERGED_PARTS, qw.SEEN, qw.HOLD, HISTORY, ACTIONS, _silent(f"SELECT {AT} AS t"), SEQUENCED, CONVERGED).replace("WITH ", "WITH RECURSIVE ", 1) + TEXT_ROWS)
def signal_texts(spark, sf_dir):
    """What the signals of all families say: title, first fact (that of an action is a reason, and left out), risks, unknowns, and the sum of its features."""
    said = all_signals(spark, sf_dir)
    action = F.col("family").isin("tracked_entity_action", "resting_order_placed")
    fact = F.when(~action, F.get("supporting_facts", F.lit(0)))
    features = F.aggregate(F.map_values("feature_vector"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return said.select("family", "asset_id", "wallet", F.unix_micros("triggered_at").alias("us"), fact.alias("fact"), F.round(features, 3).alias("features"), F.array_join("risks", " | ").alias("risks"), F.array_join("unknowns", " | ").alias("unknowns"), "title")


ALERT = AlertConfig(max_per_run=200)
ACTED = ACTION_ROWS.replace("round(sig, 6)", "sig")


@query(
    "alert_decisions",
    sql.with_(*TRACKED_PARTS, ACTIONS, sql.decisions("", f"SELECT * FROM ({ACTED})", f"SELECT *, true AS delivered FROM ({ACTED}) WHERE significance < 0.3", ALERT)).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT i::INTEGER AS place, family, asset_id, wallet, round(significance, 6) AS significance, CASE WHEN family = 'resting_order_placed' THEN 'elevated' ELSE 'normal' END AS risk_band, decision FROM dec",
)
def alert_decisions(spark, sf_dir):
    signals = k_actions(spark, sf_dir)
    history = signals.where("significance < 0.3").select("family", "asset_id", "wallet", "triggered_at", F.lit(True).alias("delivered"))
    return policy.dispatch(signals, history, ALERT).select("place", "family", "asset_id", "wallet", F.round("significance", 6).alias("significance"), "risk_band", "decision")


#: Signals to grade: every click of the stream is one of a family, with a significance from its value.
STORED = f"""
ss AS (
  SELECT event_id AS signal_id, CASE WHEN side = 'buy' THEN 'tracked_entity_action' WHEN side = 'sell' THEN 'silent_accumulation' ELSE 'sequence_confirmation' END AS family, asset_id, us, (least(usd_value, 100) / 100)::DOUBLE AS significance
  FROM ev WHERE us <= {AT}
), gr AS (
  SELECT ss.*, min(o.t0) AS hit_us FROM ss LEFT JOIN o ON o.asset_id = ss.asset_id AND o.t0 > ss.us AND o.seen <= {AT} AND outcome_class IN {PREDICTIVE} GROUP BY ALL
), gd AS (
  SELECT *, CASE WHEN asset_id IS NULL THEN 'not_applicable' WHEN hit_us IS NOT NULL THEN 'hit' WHEN {AT} - us >= {10 * DAY} THEN 'miss' ELSE 'pending' END AS grade FROM gr
)"""
GRADE_PARTS = (*qo.BASE, STORED)


def stored(spark, sf_dir):
    """A pending signal per click."""
    family = F.when(F.col("side") == "buy", "tracked_entity_action").when(F.col("side") == "sell", "silent_accumulation").otherwise("sequence_confirmation")
    return wm.visible(clicks(spark, sf_dir), qo.as_of()).select(
        F.col("event_id").alias("signal_id"), family.alias("family"), "asset_id", F.col("observed_at").alias("triggered_at"), (F.least("usd_value", F.lit(100.0)) / 100).alias("significance"), F.lit("pending").alias("grade")
    )


def graded(spark, sf_dir):
    return nl.grade(stored(spark, sf_dir), qo.k_outcomes(spark, sf_dir), qo.as_of(), horizon_days=10)


@query("graded_signals", sql.with_(*GRADE_PARTS) + f"SELECT signal_id, family, grade, CASE WHEN grade = 'hit' THEN round((hit_us - us) / {DAY}.0, 2) END AS lead_time_days FROM gd")
def graded_signals(spark, sf_dir):
    return graded(spark, sf_dir).select("signal_id", "family", "grade", "lead_time_days")


@query("family_precision", sql.with_(*GRADE_PARTS) + "SELECT family, count(*) AS graded, count(*) FILTER (grade = 'hit') AS hits, round(count(*) FILTER (grade = 'hit') / count(*), 6) AS precision FROM gd WHERE grade IN ('hit', 'miss') GROUP BY 1")
def family_precision(spark, sf_dir):
    return qw.rounded(nl.family_precision(graded(spark, sf_dir)))


@query(
    "threshold_sweep",
    sql.with_(*GRADE_PARTS) + f"SELECT t AS threshold, count(gd.signal_id) AS survivors, round(coalesce(count(*) FILTER (grade = 'hit') / nullif(count(gd.signal_id), 0), 0), 6) AS precision FROM (SELECT unnest({[float(t) for t in nl.THRESHOLDS]}::DOUBLE[]) AS t) LEFT JOIN gd ON significance >= t AND grade IN ('hit', 'miss') GROUP BY 1",
)
def threshold_sweep(spark, sf_dir):
    return qw.rounded(nl.threshold_sweep(graded(spark, sf_dir)))


PROPOSED = f"""
ts AS (SELECT t, row_number() OVER (ORDER BY t) AS i, count(gd.signal_id) AS survivors, coalesce(count(*) FILTER (grade = 'hit') / nullif(count(gd.signal_id), 0), 0) AS p
  FROM (SELECT unnest({[float(t) for t in nl.THRESHOLDS]}::DOUBLE[]) AS t) LEFT JOIN gd ON significance >= t AND grade IN ('hit', 'miss') GROUP BY 1),
tp(i, best, p) AS (
  SELECT 0::BIGINT, 0.35::DOUBLE, p FROM ts WHERE t = 0.35
  UNION ALL SELECT ts.i, CASE WHEN ts.p > tp.p + 0.05 AND survivors >= 10 THEN ts.t ELSE best END, CASE WHEN ts.p > tp.p + 0.05 AND survivors >= 10 THEN ts.p ELSE tp.p END FROM tp JOIN ts ON ts.i = tp.i + 1
)"""


@query(
    "threshold_proposal",
    sql.with_(*GRADE_PARTS, PROPOSED).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT 0.35::DOUBLE AS current, CASE WHEN n >= 20 THEN best ELSE 0.35 END::DOUBLE AS proposed, n AS graded FROM tp, (SELECT count(*) AS n FROM gd WHERE grade IN ('hit', 'miss')) WHERE i = (SELECT max(i) FROM ts)",
)
def threshold_proposal(spark, sf_dir):
    return nl.threshold_proposal(graded(spark, sf_dir))


@query(
    "mute_proposals",
    sql.with_(*GRADE_PARTS)
    + f""", fp AS (SELECT family, count(*) AS graded, count(*) FILTER (grade = 'hit') / count(*) AS precision FROM gd WHERE grade IN ('hit', 'miss') GROUP BY 1),
br AS (SELECT (SELECT count(DISTINCT asset_id) FROM o WHERE outcome_class = 'price_run' AND seen <= {AT}) / (SELECT count(*) FROM ast WHERE first_seen <= {AT}) AS r)
SELECT * FROM (SELECT family, CASE WHEN family <> 'silent_accumulation' AND precision < r THEN 'mute_family' WHEN family = 'silent_accumulation' AND precision > 2 * r THEN 'unmute_family' END AS kind, graded, round(precision, 6) AS precision, round(r, 6) AS base_rate FROM fp, br WHERE graded >= 30) WHERE kind IS NOT NULL""",
)
def mute_proposals(spark, sf_dir):
    rates = oc.base_rates(qo.k_outcomes(spark, sf_dir), qo.k_assets(spark, sf_dir), qo.as_of(), PREDICTIVE)
    return qw.rounded(nl.mute_proposals(nl.family_precision(graded(spark, sf_dir)), rates))


#: Entries of the backtest: every purchase of the clickstream.
FILLS = f"""
en AS (SELECT event_id AS entry_id, asset_id, us, us + 300000000 AS fill_us FROM ev WHERE side = 'buy' AND asset_id IS NOT NULL),
fl AS (SELECT en.*, close AS p FROM en ASOF LEFT JOIN cd ON en.asset_id = cd.asset_id AND en.fill_us >= cd.s),
tr0 AS (SELECT fl.*, p * 1.015 AS fill_price, fill_us + {3 * DAY} AS exit_us FROM fl WHERE coalesce(p > 0, false)),
rt AS (SELECT tr0.*, cd.close AS exit_price, 1000 * ((coalesce(cd.close, 0) - fill_price) / fill_price) - 3.0 AS pnl FROM tr0 ASOF LEFT JOIN cd ON tr0.asset_id = cd.asset_id AND tr0.exit_us >= cd.s)"""
FILL_PARTS = (sql.EVENTS, sql.CANDLES_K, FILLS)


def entries(spark, sf_dir):
    return clicks(spark, sf_dir).where(fn.bought(F.col("side")) & F.col("asset_id").isNotNull()).select(F.col("event_id").alias("entry_id"), "asset_id", F.col("observed_at").alias("signal_at"))


def k_fills(spark, sf_dir):
    return bt.fills(entries(spark, sf_dir), adapters.clickstream_candles(spark, sf_dir), BACKTEST)


def k_returns(spark, sf_dir):
    return bt.returns(k_fills(spark, sf_dir), adapters.clickstream_candles(spark, sf_dir), BACKTEST)


@query("price_asof", sql.with_(*FILL_PARTS) + "SELECT entry_id, asset_id, round(p, 6) AS price FROM fl")
def price_asof(spark, sf_dir):
    points = entries(spark, sf_dir).withColumn("fill_us", F.unix_micros("signal_at") + 300_000_000)
    return bt.prices_at(points, adapters.clickstream_candles(spark, sf_dir), "fill_us", "price", BACKTEST).select("entry_id", "asset_id", F.round("price", 6).alias("price"))


@query("fills", sql.with_(*FILL_PARTS) + "SELECT entry_id, asset_id, round(CASE WHEN p > 0 THEN p * 1.015 END, 6) AS fill_price, CASE WHEN p > 0 THEN 3.0 END AS fees_usd, CASE WHEN coalesce(p > 0, false) THEN NULL ELSE 'no_price_at_entry' END AS rejected_reason FROM fl")
def fills(spark, sf_dir):
    return k_fills(spark, sf_dir).select("entry_id", "asset_id", F.round("fill_price", 6).alias("fill_price"), "fees_usd", "rejected_reason")


@query("backtest_returns", sql.with_(*FILL_PARTS) + "SELECT entry_id, round(exit_price, 6) AS exit_price, round(pnl, 4) AS pnl_usd FROM rt")
def backtest_returns(spark, sf_dir):
    return k_returns(spark, sf_dir).select("entry_id", F.round("exit_price", 6).alias("exit_price"), F.round("pnl_usd", 4).alias("pnl_usd"))


EQUITY = "eq AS (SELECT entry_id, fill_us, sum(pnl) OVER w AS equity FROM rt WINDOW w AS (ORDER BY fill_us, entry_id ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY fill_us, entry_id ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"


@query("equity_drawdown", sql.with_(*FILL_PARTS, EQUITY) + "SELECT entry_id, round(equity, 2) AS equity, round(equity - peak, 2) AS drawdown FROM dd")
def equity_drawdown(spark, sf_dir):
    return bt.equity(k_returns(spark, sf_dir)).select("entry_id", F.round("equity", 2).alias("equity"), F.round("drawdown", 2).alias("drawdown"))


@query(
    "backtest_summary",
    sql.with_(*FILL_PARTS, EQUITY)
    + "SELECT count(*) AS trades, (SELECT count(*) FROM fl WHERE NOT coalesce(p > 0, false)) AS rejected, count(*) FILTER (pnl > 0) AS wins, round(median(pnl / 1000), 6) AS median_return, round(avg(pnl / 1000), 6) AS mean_return, round(sum(pnl), 2) AS total_return_usd, (SELECT round(least(0, min(equity - peak)), 2) FROM dd) AS max_drawdown FROM rt",
)
def backtest_summary(spark, sf_dir):
    found = bt.summary(k_fills(spark, sf_dir), k_returns(spark, sf_dir))
    return found.select("trades", "rejected", "wins", F.round("median_return", 6).alias("median_return"), F.round("mean_return", 6).alias("mean_return"), F.round("total_return_usd", 2).alias("total_return_usd"), F.round("max_drawdown", 2).alias("max_drawdown"))


START_US, END_US = 1_704_067_200_000_000, 1_706_572_800_000_000
HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
DRAWN = f"""
kn AS (SELECT asset_id, row_number() OVER (ORDER BY {HEX.format("'7:order:' || asset_id")}, asset_id) - 1 AS slot FROM ast WHERE first_seen <= {END_US}),
dr AS (SELECT i AS entry_id, floor({HEX.format("'7:asset:' || i")} * (SELECT count(*) FROM kn)::DOUBLE / 4294967296)::BIGINT AS slot, {HEX.format("'7:time:' || i")} % 1000000 AS u FROM range(2000) t(i)),
en AS (SELECT entry_id, asset_id, us, us + 300000000 AS fill_us FROM (SELECT entry_id, asset_id, {START_US} + floor({END_US - START_US} * 0.6::DOUBLE * u / 1000000)::BIGINT AS us FROM dr JOIN kn USING (slot)))"""
FILLED = "fl AS" + FILLS.split("fl AS", 1)[1]


@query(
    "random_baseline",
    sql.with_(sql.EVENTS, sql.CANDLES_K, sql.ASSETS, DRAWN, FILLED, EQUITY)
    + "SELECT count(*) AS trades, (SELECT count(*) FROM fl WHERE NOT coalesce(p > 0, false)) AS rejected, count(*) FILTER (pnl > 0) AS wins, round(count(*) FILTER (pnl > 0) / count(*), 4) AS hit_rate, round(median(pnl / 1000), 4) AS median_return, round(avg(pnl / 1000), 4) AS mean_return, "
    "round(min(pnl / 1000), 4) AS worst_return, round(max(pnl / 1000), 4) AS best_return, round(sum(pnl), 4) AS total_return_usd, (SELECT round(least(0, min(equity - peak)), 4) FROM dd) AS max_drawdown FROM rt",
)
def random_baseline(spark, sf_dir):
    events = clicks(spark, sf_dir)
    start, end = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-30 00:00:00").cast("timestamp")
    drawn = bt.random_entries(adapters.assets_of(events), 2000, start, end)
    candles = adapters.clickstream_candles(spark, sf_dir)
    filled = bt.fills(drawn, candles, BACKTEST)
    return qw.rounded(bt.summary(filled, bt.returns(filled, candles, BACKTEST)), 4)


@query("random_draws", sql.with_(sql.EVENTS, sql.ASSETS, DRAWN) + "SELECT entry_id, asset_id, us FROM en")
def random_draws(spark, sf_dir):
    start, end = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-30 00:00:00").cast("timestamp")
    drawn = bt.random_entries(adapters.assets_of(clicks(spark, sf_dir)), 2000, start, end)
    return drawn.select("entry_id", "asset_id", F.unix_micros("signal_at").alias("us"))


AUDIT = f"""
l AS (SELECT l_partkey, epoch_us(l_shipdate) AS s, epoch_us(o_orderdate) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fo AS (SELECT asset_id, outcome_class, t0, CASE WHEN t0 // {DAY} % 7 = 0 THEN t0 - 1 ELSE seen END AS seen FROM oc)"""


@query(
    "leakage_audit",
    sql.with_(sql.CANDLES_PART, sql.outcomes(qo.PART), AUDIT)
    + f"""SELECT 'outcome_first_observed_at_not_before_t0' AS check_name, count(*) FILTER (seen < t0) = 0 AS passed, count(*) FILTER (seen < t0) AS bad FROM fo
UNION ALL SELECT 'event_observed_at_not_before_chain_time', count(*) FILTER (s < o) = 0, count(*) FILTER (s < o) FROM l
UNION ALL SELECT 'universe_includes_non_performers', n > 0 AND w < 0.5 * n, w FROM (SELECT count(DISTINCT asset_id) FILTER (outcome_class IN {PREDICTIVE}) AS w FROM fo), (SELECT count(DISTINCT l_partkey) AS n FROM l)
UNION ALL SELECT 'observation_lag_recorded', count(*) > 0, 0 FROM (SELECT 1 FROM l LIMIT 1)""",
)
def leakage_audit(spark, sf_dir):
    """Orders as chain time and shipments as observation; some outcomes are said to be seen before they happened. The audit must find both."""
    line, orders = adapters.read(spark, sf_dir, "lineitem"), adapters.read(spark, sf_dir, "orders")
    events = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_shipdate").cast("timestamp").alias("observed_at"), F.col("o_orderdate").cast("timestamp").alias("chain_time"))
    assets = adapters.assets_of(adapters.market_events(spark, sf_dir))
    t0 = F.unix_micros("t0")
    early = F.floor(t0 / DAY) % 7 == 0
    outcomes = oc.detect_all(adapters.market_candles(spark, sf_dir), qo.PART).withColumn("first_observed_at", F.when(early, F.timestamp_micros(t0 - 1)).otherwise(F.col("first_observed_at")))
    return bt.leakage_audit(events, outcomes, assets, F.lit("2030-01-01").cast("timestamp"))
