"""Queries: metrics of actors, archetypes, discovery scores, lifecycle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracklight.functions import tables
from tracklight.operators import discovery as ds
from tracklight.operators import metrics as wm
from tracklight.operators import outcomes as oc
from tracklight.plans import q_outcomes as qo
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY, HOUR, PREDICTIVE, WalletConfig
from tracklight.sources import adapters

#: The clickstream's users act all the time, so the exclusions are set for its pace.
WALLETS = WalletConfig(most_trades_per_month=400, most_tokens_per_month=400, active_actions=10_000, sniper_seconds=3600, sniper_entries=10, quiet_trades_per_month=120, quiet_edge=0.5, listing_rate=0.95, revival_rate=0.6, collapse_share=0.9)
DISCOVERY = qo.K_DISCOVERY
AT = qo.AS_OF_US
EV = f"SELECT * FROM ev WHERE us <= {AT}"

SEEN = f"e AS ({EV})"
ACTIVITY = f"""
act AS (
  SELECT actor, count(*) AS total_actions, count(*) FILTER (acquired) AS acquisitions, count(DISTINCT asset_id) FILTER (acquired) AS distinct_tokens,
    count(DISTINCT us // {DAY}) AS active_days, count(DISTINCT us // {HOUR} % 24) AS distinct_active_hours,
    count(*) FILTER (event_type = 'order_placed' AND NOT filled) AS resting_orders, count(*) FILTER (event_type = 'liquidation') AS liquidations,
    greatest((max(us) - min(us)) / {DAY}.0, 1.0) / 30.44 AS months, total_actions / months AS trades_per_month, distinct_tokens / months AS tokens_per_month
  FROM e GROUP BY actor
)"""


def seen(spark, sf_dir):
    return wm.visible(adapters.clickstream_events(spark, sf_dir), qo.as_of())


def known(spark, sf_dir):
    return qo.k_outcomes(spark, sf_dir).where(F.col("first_observed_at") <= qo.as_of())


def rounded(df, digits=6):
    """Doubles rounded, so that different orders of summing agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("wallet_activity", sql.with_(sql.EVENTS, SEEN, ACTIVITY) + "SELECT * EXCLUDE (months) REPLACE (round(trades_per_month, 6) AS trades_per_month, round(tokens_per_month, 6) AS tokens_per_month) FROM act")
def wallet_activity(spark, sf_dir):
    return rounded(wm.activity(seen(spark, sf_dir)))


@query("wallet_sizes", sql.with_(sql.EVENTS, SEEN) + "SELECT actor, median(usd_value) AS median_position_usd, max(usd_value) AS max_position_usd FROM e WHERE usd_value IS NOT NULL GROUP BY actor")
def wallet_sizes(spark, sf_dir):
    return wm.sizes(seen(spark, sf_dir))


def creations(events):
    """Creation events of the assets, which the driver tables lack: an asset exists from its first event on."""
    return events.where("asset_id IS NOT NULL").groupBy("asset_id").agg(F.min("chain_time").alias("chain_time")).withColumn("event_type", F.lit("token_created"))


@query(
    "entry_latency",
    sql.with_(sql.EVENTS, SEEN, "cr AS (SELECT asset_id, min(us) AS born FROM ev WHERE asset_id IS NOT NULL GROUP BY 1)")
    + "SELECT actor, min((us - born) / 1e6) AS min_entry_latency_seconds, count(*) FILTER ((us - born) / 1e6 <= 3600) AS sniper_entries FROM e JOIN cr USING (asset_id) WHERE acquired GROUP BY actor",
)
def entry_latency(spark, sf_dir):
    return wm.entry_latency(seen(spark, sf_dir), creations(adapters.clickstream_events(spark, sf_dir)), WALLETS)


HOLD = f"""
turn AS (
  SELECT * FROM (SELECT actor, asset_id, us, event_id, side, lag(side) OVER w AS before FROM e WHERE asset_id IS NOT NULL AND side IN ('buy', 'sell') WINDOW w AS (PARTITION BY actor, asset_id ORDER BY us, event_id)) WHERE side IS DISTINCT FROM before
), hold AS (
  SELECT actor, (next - us) / {HOUR}.0 AS hours FROM (SELECT *, lead(us) OVER (PARTITION BY actor, asset_id ORDER BY us, event_id) AS next FROM turn) WHERE side = 'buy' AND next IS NOT NULL
)"""


@query("hold_hours", sql.with_(sql.EVENTS, SEEN, HOLD) + "SELECT actor, round(median(hours), 6) AS median_hold_hours, count(*) AS episodes_closed FROM hold GROUP BY actor")
def hold_hours(spark, sf_dir):
    return rounded(wm.hold_hours(seen(spark, sf_dir)))


@query(
    "realized_pnl",
    sql.with_(sql.EVENTS, SEEN, """
b AS (SELECT *, coalesce(sum((coalesce(side, '') = 'sell')::INT) OVER (PARTITION BY actor, asset_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM e WHERE asset_id IS NOT NULL AND usd_value IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN side = 'buy' THEN usd_value ELSE 0 END) OVER (PARTITION BY actor, asset_id, blk) AS spent FROM b)""")
    + "SELECT actor, round(sum(CASE WHEN side = 'buy' THEN 0 WHEN side = 'sell' AND spent > 0 THEN usd_value - spent WHEN event_type = 'liquidation' THEN -usd_value ELSE 0 END), 4) AS realized_pnl_usd FROM s GROUP BY actor",
)
def realized_pnl(spark, sf_dir):
    return rounded(wm.realized_pnl(seen(spark, sf_dir)), 4)


CLASSES = list(wm.CLASSES)
PRECISION = f"""
rate AS (SELECT c AS outcome_class, (SELECT count(DISTINCT asset_id) FROM o WHERE outcome_class = c AND seen <= {AT}) / (SELECT count(*) FROM ast WHERE first_seen <= {AT}) AS base_rate FROM (SELECT unnest({CLASSES}) AS c)),
touch AS (SELECT actor, asset_id, min(us) AS entry FROM e WHERE acquired AND asset_id IS NOT NULL GROUP BY 1, 2),
hit AS (SELECT actor, c AS outcome_class, count(*) AS trials, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE o.asset_id = touch.asset_id AND outcome_class = c AND seen <= {AT} AND t0 > entry)) AS hits FROM touch, (SELECT unnest({CLASSES}) AS c) GROUP BY ALL),
prec AS (
  SELECT actor, outcome_class, hits, trials, hits / trials AS hit_rate, (hits + 8 * base_rate) / (trials + 8) AS shrunk_hit_rate, base_rate,
    CASE WHEN base_rate > 0 THEN (hits + 8 * base_rate) / (trials + 8) / base_rate ELSE 0 END AS edge_ratio FROM hit JOIN rate USING (outcome_class)
)"""
ROUND_PREC = "round(hit_rate, 6) AS hit_rate, round(shrunk_hit_rate, 6) AS shrunk_hit_rate, round(base_rate, 6) AS base_rate, round(edge_ratio, 6) AS edge_ratio"


@query("precision_by_class", sql.with_(*qo.BASE, SEEN, PRECISION) + f"SELECT * REPLACE ({ROUND_PREC}) FROM prec")
def precision_by_class(spark, sf_dir):
    outcomes = known(spark, sf_dir)
    return rounded(wm.precision(seen(spark, sf_dir), outcomes, oc.base_rates(outcomes, qo.k_assets(spark, sf_dir), qo.as_of(), CLASSES), WALLETS))


EARLY = f"""
led AS (
  SELECT e.actor, e.asset_id, e.event_id, e.us, min(o.t0) AS t0 FROM e JOIN o ON o.asset_id = e.asset_id AND o.t0 > e.us
  WHERE e.acquired AND o.seen <= {AT} AND o.outcome_class IN {PREDICTIVE} GROUP BY ALL
), fb AS (
  SELECT asset_id, actor, min(us) AS first_buy FROM e WHERE side = 'buy' GROUP BY 1, 2
), rk AS (
  SELECT led.actor, led.event_id, led.us, led.t0, count(fb.actor) AS buyers, count(fb.actor) FILTER (fb.first_buy < led.us) AS before
  FROM led LEFT JOIN fb ON fb.asset_id = led.asset_id AND fb.first_buy < led.t0 GROUP BY ALL
), early AS (
  SELECT actor, median((t0 - us) / {DAY}.0) AS median_lead_days, median(CASE WHEN buyers > 0 THEN before / buyers ELSE 1.0 END) AS median_buyer_rank FROM rk GROUP BY actor
)"""


@query("lead_times", sql.with_(*qo.BASE, SEEN, EARLY) + "SELECT actor, round(median_lead_days, 6) AS median_lead_days, round(median_buyer_rank, 6) AS median_buyer_rank FROM early")
def lead_times(spark, sf_dir):
    return rounded(wm.earliness(seen(spark, sf_dir), known(spark, sf_dir)))


def k_metrics(spark, sf_dir):
    events = adapters.clickstream_events(spark, sf_dir)
    return wm.wallet_metrics(events, qo.k_outcomes(spark, sf_dir), qo.k_assets(spark, sf_dir), qo.as_of(), config=WALLETS)


ARCHETYPE = f"""
m AS (
  SELECT act.*, coalesce(h.hits, 0) AS run_hits, r.shrunk_hit_rate AS run_shrunk, r.edge_ratio AS run_edge, l.hit_rate AS listing_rate, l.hits AS listing_hits, v.hit_rate AS revival_rate, v.hits AS revival_hits, coalesce(x.hit_rate, 0) AS collapse_share
  FROM act LEFT JOIN prec h ON h.actor = act.actor AND h.outcome_class = 'price_run' LEFT JOIN prec r ON r.actor = act.actor AND r.outcome_class = 'price_run'
    LEFT JOIN prec l ON l.actor = act.actor AND l.outcome_class = 'cex_listing' LEFT JOIN prec v ON v.actor = act.actor AND v.outcome_class = 'revival' LEFT JOIN prec x ON x.actor = act.actor AND x.outcome_class = 'rug_or_collapse'
), arch AS (
  SELECT *, CASE
    WHEN distinct_active_hours >= {WALLETS.active_hours} AND total_actions > {WALLETS.active_actions} THEN 'bot'
    WHEN trades_per_month > {WALLETS.most_trades_per_month} OR tokens_per_month > {WALLETS.most_tokens_per_month} THEN 'high_frequency'
    WHEN distinct_tokens < {WALLETS.least_tokens} THEN 'unclassified'
    WHEN collapse_share >= {WALLETS.collapse_share} THEN 'pump_operator'
    WHEN listing_rate >= {WALLETS.listing_rate} AND listing_hits >= 3 THEN 'listing_predictor'
    WHEN revival_rate >= {WALLETS.revival_rate} AND revival_hits >= 3 THEN 'revival_specialist'
    WHEN trades_per_month <= {WALLETS.quiet_trades_per_month} AND run_shrunk >= {WALLETS.quiet_shrunk} AND run_edge >= {WALLETS.quiet_edge} THEN 'informed_accumulator'
    ELSE 'unclassified' END AS archetype FROM m
)"""
SCORE_PARTS = (*qo.BASE, SEEN, ACTIVITY, PRECISION, ARCHETYPE, qo.APPEARANCES)


@query("archetypes", sql.with_(*SCORE_PARTS) + "SELECT actor, archetype, distinct_tokens, total_actions, round(collapse_share, 6) AS collapse_share FROM arch")
def archetypes(spark, sf_dir):
    return rounded(k_metrics(spark, sf_dir).select("actor", "archetype", "distinct_tokens", "total_actions", "collapse_share"))


def k_scores(spark, sf_dir):
    events, outcomes = adapters.clickstream_events(spark, sf_dir), qo.k_outcomes(spark, sf_dir)
    return ds.sweep(events, outcomes, qo.k_assets(spark, sf_dir), qo.as_of(), config=DISCOVERY, wallets=WALLETS)


SCORES = f"""
sc0 AS (
  SELECT app.actor, count(DISTINCT app.asset_id) AS hits, count(*) AS appearances, median((app.t0 - app.entered_at) / {DAY}.0) AS median_lead_days, avg(coalesce(base_rate, 0)) AS base_rate
  FROM app LEFT JOIN rate ON rate.outcome_class = app.outcome_class GROUP BY app.actor
), sc AS (
  SELECT sc0.*, coalesce(distinct_tokens, 0) AS touched, archetype, (hits + 8 * base_rate) / (greatest(touched, hits) + 8) AS shrunk_hit_rate,
    CASE WHEN base_rate > 0 THEN (hits + 8 * base_rate) / (greatest(touched, hits) + 8) / base_rate ELSE 0 END AS edge_ratio
  FROM sc0 LEFT JOIN arch ON arch.actor = sc0.actor
)"""


@query(
    "discovery_scores",
    sql.with_(*SCORE_PARTS, SCORES) + "SELECT actor, hits, appearances, touched, archetype, round(median_lead_days, 6) AS median_lead_days, round(base_rate, 6) AS base_rate, round(shrunk_hit_rate, 6) AS shrunk_hit_rate, round(edge_ratio, 6) AS edge_ratio FROM sc",
)
def discovery_scores(spark, sf_dir):
    return rounded(k_scores(spark, sf_dir).select("actor", "hits", "appearances", "touched", "archetype", "median_lead_days", "base_rate", "shrunk_hit_rate", "edge_ratio"))


REJECT = f"""
rej AS (
  SELECT *, CASE WHEN archetype IN ('bot', 'high_frequency') THEN 'excluded_archetype' WHEN hits < {DISCOVERY.min_events} THEN 'too_few_events'
    WHEN edge_ratio < {DISCOVERY.min_edge} THEN 'edge_vs_base_rate' WHEN shrunk_hit_rate < {DISCOVERY.min_shrunk} THEN 'shrunk_hit_rate' END AS reason FROM sc
)"""


@query("rejections", sql.with_(*SCORE_PARTS, SCORES, REJECT) + "SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM rej GROUP BY 1")
def rejections(spark, sf_dir):
    reason = F.coalesce(F.substring_index("rejection_reason", ":", 1), F.lit("passed"))
    return k_scores(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("near_misses", sql.with_(*SCORE_PARTS, SCORES, REJECT) + "SELECT actor, hits, round(edge_ratio, 6) AS edge_ratio FROM rej WHERE reason IS NOT NULL ORDER BY hits DESC, rej.edge_ratio DESC, actor LIMIT 25")
def near_misses(spark, sf_dir):
    return rounded(ds.near_misses(k_scores(spark, sf_dir), DISCOVERY).select("actor", "hits", "edge_ratio"))


CAND = f"""
cand AS (
  SELECT c_custkey::VARCHAR AS wallet, CASE c_custkey % 4 WHEN 0 THEN 'surfaced' WHEN 1 THEN 'shadow' WHEN 2 THEN 'shadow' ELSE 'tracked' END AS status,
    {AT} - (c_custkey % 60) * {DAY} AS shadow_us, 1 + (c_custkey % 17) / 10.0 AS edge FROM customer
)"""


def candidates_of_customers(spark, sf_dir):
    """A candidate table over customers: statuses, shadow starts and edges from their keys."""
    key = F.col("c_custkey")
    status = F.when(key % 4 == 0, "surfaced").when(key % 4 == 3, "tracked").otherwise("shadow")
    none = lambda t: F.lit(None).cast(t)
    return adapters.read(spark, sf_dir, "customer").select(
        key.cast("string").alias("wallet"), F.lit("clicks").alias("network"), status.alias("status"), qo.as_of().alias("surfaced_at"), F.timestamp_micros(F.lit(AT) - (key % 60) * DAY).alias("shadow_started_at"), none("timestamp").alias("promoted_at"), none("timestamp").alias("retired_at"),
        F.lit("unclassified").alias("archetype"), none("double").alias("hit_rate"), none("double").alias("shrunk_hit_rate"), none("double").alias("base_rate"), (1 + (key % 17) / 10.0).alias("edge_vs_base"),
        none("int").alias("sample_size"), none("int").alias("independent_events"), none("string").alias("rejection_reason"), none(ds.PROVENANCE).alias("discovery_provenance"),
    )


@query(
    "lifecycle_step",
    sql.with_(CAND) + f"SELECT wallet, CASE WHEN status = 'surfaced' THEN 'shadow' WHEN status = 'shadow' AND {AT} - shadow_us >= {30 * DAY} THEN CASE WHEN edge >= 1.8 THEN 'tracked' ELSE 'decaying' END ELSE status END AS status FROM cand",
)
def lifecycle_step(spark, sf_dir):
    return ds.advance_lifecycle(candidates_of_customers(spark, sf_dir), qo.as_of()).select("wallet", "status")


CONTROL = """
ca AS (SELECT DISTINCT actor FROM ev ORDER BY actor LIMIT 500), cp AS (SELECT actor, row_number() OVER (ORDER BY actor) - 1 AS i, greatest(1, count(*) OVER () // 40) AS step FROM ca),
cs AS (SELECT actor FROM cp WHERE i % step = 0 ORDER BY actor LIMIT 40)"""


@query("negative_control", sql.with_(sql.EVENTS, CONTROL) + "SELECT 'random_wallet' AS name, 0::BIGINT AS surfaced, 0.0::DOUBLE AS median_edge_ratio, count(*)::VARCHAR || ' wallets sampled with no outcome appearances attributed' AS note FROM cs")
def negative_control(spark, sf_dir):
    return ds.negative_control(adapters.clickstream_events(spark, sf_dir), k_metrics(spark, sf_dir), DISCOVERY)


@query("control_scores", sql.with_(*qo.BASE, SEEN, ACTIVITY, PRECISION, ARCHETYPE, CONTROL) + f"SELECT actor, CASE WHEN archetype IN ('bot', 'high_frequency') THEN 'excluded_archetype' ELSE 'too_few_events:0<{DISCOVERY.min_events}' END AS reason FROM cs LEFT JOIN arch USING (actor)")
def control_scores(spark, sf_dir):
    found = ds.control_scores(adapters.clickstream_events(spark, sf_dir), k_metrics(spark, sf_dir), DISCOVERY)
    return found.select("actor", F.when(F.col("rejection_reason").startswith("excluded"), F.substring_index("rejection_reason", ":", 1)).otherwise(F.col("rejection_reason")).alias("reason"))


@query("holding", sql.with_(sql.EVENTS, SEEN, HOLD, """
b AS (SELECT *, coalesce(sum((coalesce(side, '') = 'sell')::INT) OVER (PARTITION BY actor, asset_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM e WHERE asset_id IS NOT NULL AND usd_value IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN side = 'buy' THEN usd_value ELSE 0 END) OVER (PARTITION BY actor, asset_id, blk) AS spent FROM b),
pl AS (SELECT actor, sum(CASE WHEN side = 'buy' THEN 0 WHEN side = 'sell' AND spent > 0 THEN usd_value - spent WHEN event_type = 'liquidation' THEN -usd_value ELSE 0 END) AS pnl FROM s GROUP BY actor),
hh AS (SELECT actor, median(hours) AS mh, count(*) AS n FROM hold GROUP BY 1)""") + "SELECT pl.actor, round(mh, 4) AS median_hold_hours, coalesce(n, 0) AS episodes_closed, round(pnl, 4) AS realized_pnl_usd FROM pl LEFT JOIN hh USING (actor)")  # fmt: skip
def holding(spark, sf_dir):
    """Both measures of an actor's trades, from the one pass that the metrics take."""
    return rounded(wm.holding(seen(spark, sf_dir)), 4)


@query(
    "candidate_persist",
    sql.with_(*SCORE_PARTS, SCORES, "fx AS (SELECT actor, list_sort(list(t)) AS ts FROM (SELECT actor, asset_id, min(t0) AS t FROM app GROUP BY 1, 2) GROUP BY 1)", REJECT).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", kn AS (SELECT actor AS wallet FROM sc WHERE actor LIKE '%3'), nm AS (SELECT actor FROM rej WHERE reason IS NOT NULL ORDER BY hits DESC, edge_ratio DESC, actor LIMIT 25),
pv AS (SELECT actor, count(*) AS n, arg_min(split_part(asset_id, ':', 1), struct_pack(a := t0, b := outcome_id)) AS network FROM app GROUP BY 1)
SELECT rej.actor AS wallet, CASE WHEN kn.wallet IS NOT NULL THEN 'tracked' WHEN reason IS NULL THEN 'surfaced' ELSE 'rejected' END AS status, CASE WHEN kn.wallet IS NOT NULL THEN {AT - DAY} ELSE {AT} END AS surfaced_us,
  archetype, round_even(edge_ratio, 4) AS edge_vs_base, coalesce(pv.network, '') AS network, pv.n AS n_provenance
FROM rej LEFT JOIN kn ON kn.wallet = rej.actor LEFT JOIN nm ON nm.actor = rej.actor LEFT JOIN pv ON pv.actor = rej.actor WHERE reason IS NULL OR kn.wallet IS NOT NULL OR nm.actor IS NOT NULL""",
)
def candidate_persist(spark, sf_dir):
    """Some actors are candidates already; the sweep gives them new figures, adds those that pass, and the nearest misses."""
    scores, appearing = tables.keep(k_scores(spark, sf_dir)), qo.k_appearances(spark, sf_dir)
    blank = spark.createDataFrame([], ds.CANDIDATES)
    none = {f.name: F.lit(None).cast(f.dataType) for f in blank.schema if f.name not in ("wallet", "status", "surfaced_at")}
    known = scores.where(F.col("actor").endswith("3")).select(F.col("actor").alias("wallet"), F.lit("tracked").alias("status"), F.timestamp_micros(F.lit(AT - DAY)).alias("surfaced_at")).withColumns(none).select(*blank.columns)
    after = ds.persist(known, scores, qo.as_of(), DISCOVERY, appearing)
    return after.select("wallet", "status", F.unix_micros("surfaced_at").alias("surfaced_us"), "archetype", "edge_vs_base", F.coalesce("network", F.lit("")).alias("network"), F.size("discovery_provenance").cast("long").alias("n_provenance"))


#: A lower bar, so that some actors pass at both moments.
LOWER = replace(DISCOVERY, min_edge=0.8)
PASSED = sql.with_(SEEN, ACTIVITY, PRECISION, ARCHETYPE, qo.APPEARANCES, SCORES, REJECT.replace(f"edge_ratio < {DISCOVERY.min_edge}", f"edge_ratio < {LOWER.min_edge}")) + "SELECT actor FROM rej WHERE reason IS NULL"


@query(
    "discovery_backtest",
    sql.with_(*qo.BASE, f"then_ AS ({sql.at(PASSED, AT - 7 * DAY, AT)})", f"present AS ({PASSED})")
    + """SELECT *, CASE WHEN kept + lost > 0 THEN kept / (kept + lost) END::DOUBLE AS survival_rate FROM (SELECT count(*) FILTER (t.actor IS NOT NULL AND p.actor IS NOT NULL) AS kept, count(*) FILTER (p.actor IS NULL) AS lost, count(*) FILTER (t.actor IS NULL) AS gained
FROM then_ t FULL JOIN present p ON t.actor = p.actor)""",
)
def discovery_backtest(spark, sf_dir):
    """Who passed a week ago, and who of them passes now."""
    events, outcomes, assets = adapters.clickstream_events(spark, sf_dir), qo.k_outcomes(spark, sf_dir), qo.k_assets(spark, sf_dir)
    at = lambda us: ds.sweep(events, outcomes, assets, F.timestamp_micros(F.lit(us)), config=LOWER, wallets=WALLETS)
    return ds.survival(at(AT - 7 * DAY), at(AT))
