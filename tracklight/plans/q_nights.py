"""Query of two nights in a row, each from what the one before has published."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from tracklight.functions import tables
from tracklight.operators import metrics as wm
from tracklight.operators import nights
from tracklight.plans import q_graph as qg
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_signals as qs
from tracklight.plans import q_wallets as qw
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY, MUTED_FAMILIES, PREDICTIVE, AlertConfig
from tracklight.sources import adapters

NIGHTS = ("2024-01-18 00:00:00", qo.AS_OF)
TIMES = (qo.AS_OF_US - 7 * DAY, qo.AS_OF_US)
DISCOVERY, ALERT = replace(qw.DISCOVERY, shadow_days=5, min_edge=0.8), AlertConfig(max_per_run=60)
REJECT = qw.REJECT.replace(f"edge_ratio < {qw.DISCOVERY.min_edge}", f"edge_ratio < {DISCOVERY.min_edge}")


def moved(text: str, at: int) -> str:
    """SQL of the moment AS_OF, at another moment: all times in it move along."""
    return sql.at(text, at, qo.AS_OF_US)


def unrounded(text: str) -> str:
    return re.sub(r"round\((.*?), 6\)", r"\1", text)


def families_sql(at: int, edges: str = qg.EDGES) -> str:
    """All signals of a moment, from CTEs ev, o, tr (tracked) and tra (all candidates with a status), as (family, asset_id, wallet, us, significance)."""
    rows = qs.ALL_ROWS.replace("FROM tr WHERE surfaced <=", "FROM tra WHERE status <> 'rejected' AND surfaced <=").replace(f"surfaced >= {qo.AS_OF_US - 10 * DAY}", f"surfaced >= {qo.AS_OF_US - 3 * DAY}")
    history = qs.HISTORY.replace("JOIN tr ON", "JOIN tra ON")
    parts = (qg.FIRST, edges, qw.SEEN, qw.HOLD, history, qs.ACTIONS, qs._silent(f"SELECT {qo.AS_OF_US} AS t"), qs.SEQUENCED, qs.CONVERGED)
    return moved(unrounded(sql.with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1) + rows), at)


def _night_sql(n: int, at: int, before: str) -> str:
    """The CTEs of night ``n``, with its number at the end of their names; ``before`` are the stored signals (st{n}) it starts from."""
    known = f"SELECT * FROM o{n - 1} UNION ALL SELECT * FROM new{n} WHERE outcome_id NOT IN (SELECT outcome_id FROM o{n - 1})" if n > 1 else "SELECT * FROM new1"
    candles = sql.CANDLES_K.replace("GROUP BY 1, 2", f"GROUP BY 1, 2 HAVING s <= {at}")
    own = f"o AS (SELECT * FROM o{n})"
    scores = moved(sql.with_(own, sql.ASSETS, qw.SEEN, qw.ACTIVITY, qw.PRECISION, qw.ARCHETYPE, qo.APPEARANCES, qw.SCORES, REJECT), at)
    near = f"near{n} AS (SELECT actor FROM rej{n} WHERE reason IS NOT NULL ORDER BY hits DESC, edge_ratio DESC, actor LIMIT {DISCOVERY.near_misses})"
    old = f"LEFT JOIN cand{n - 1} c ON c.wallet = r.actor" if n > 1 else "LEFT JOIN (SELECT NULL::VARCHAR AS wallet, NULL::VARCHAR AS status, NULL::VARCHAR AS archetype, NULL::DOUBLE AS edge, NULL::BIGINT AS surfaced, NULL::BIGINT AS shadow_us) c ON false"
    rest = f"UNION ALL SELECT wallet, status, archetype, edge, surfaced, shadow_us, true FROM cand{n - 1} WHERE wallet NOT IN (SELECT actor FROM rej{n})" if n > 1 else ""
    muted = ", ".join(f"'{f}'" for f in MUTED_FAMILIES)
    return f"""
new{n} AS (WITH {candles.strip()}, {sql.outcomes(qo.K).strip()}, {sql.LISTINGS.strip()} SELECT * FROM oc UNION ALL SELECT * FROM lst WHERE seen <= {at}),
o{n} AS ({known}),
rej{n} AS ({scores} SELECT * FROM rej),
{near},
put{n} AS (
  SELECT actor AS wallet, coalesce(c.status, CASE WHEN reason IS NULL THEN 'shadow' ELSE 'rejected' END) AS status, coalesce(r.archetype, 'unclassified') AS archetype, round_even(edge_ratio, 4) AS edge,
    coalesce(c.surfaced, {at}) AS surfaced, CASE WHEN c.wallet IS NOT NULL THEN c.shadow_us WHEN reason IS NULL THEN {at} END AS shadow_us, c.wallet IS NOT NULL AS known
  FROM rej{n} r {old} WHERE reason IS NULL OR c.wallet IS NOT NULL OR r.actor IN (SELECT actor FROM near{n})
  {rest}
),
cand{n} AS (SELECT * EXCLUDE (known) REPLACE (CASE WHEN known AND status = 'shadow' AND {at} - shadow_us >= {int(DISCOVERY.shadow_days * DAY)} THEN CASE WHEN edge >= {DISCOVERY.min_edge} THEN 'tracked' ELSE 'decaying' END ELSE status END AS status) FROM put{n}),
sig{n} AS (WITH {own}, tra AS (SELECT * FROM cand{n}), tr AS (SELECT * FROM cand{n} WHERE status IN ('tracked', 'shadow')) SELECT * FROM ({families_sql(at)})),
st{n} AS ({before}),
gr{n} AS (
  SELECT signal_id, family, asset_id, wallet, us, significance, delivered, CASE WHEN grade <> 'pending' THEN grade WHEN asset_id IS NULL THEN 'not_applicable'
    WHEN EXISTS (SELECT 1 FROM o{n} o WHERE o.asset_id = s.asset_id AND o.t0 > s.us AND o.seen <= {at} AND outcome_class IN {PREDICTIVE}) THEN 'hit' WHEN {at} - us >= {21 * DAY} THEN 'miss' ELSE 'pending' END AS grade
  FROM st{n} s
),
pro{n} AS (WITH RECURSIVE gd AS (SELECT * FROM gr{n}), {qs.PROPOSED.strip()} SELECT CASE WHEN n >= 20 THEN best ELSE 0.35 END::DOUBLE AS proposed FROM tp, (SELECT count(*) AS n FROM gd WHERE grade IN ('hit', 'miss')) WHERE i = (SELECT max(i) FROM ts)),
fp{n} AS (SELECT family, count(*) AS graded, count(*) FILTER (grade = 'hit') / count(*) AS precision FROM gr{n} WHERE grade IN ('hit', 'miss') GROUP BY 1),
br{n} AS (SELECT (SELECT count(DISTINCT asset_id) FROM o{n} WHERE outcome_class = 'price_run' AND seen <= {at}) / (SELECT count(*) FROM ast WHERE first_seen <= {at}) AS r),
{sql.decisions(n, f"SELECT * FROM sig{n}", f"SELECT * FROM st{n}", ALERT)},
dig{n} AS (
  SELECT {n} AS night, 'candidates' AS section, status AS key, count(*)::DOUBLE AS value FROM cand{n} WHERE status IN ('tracked', 'shadow') GROUP BY 3
  UNION ALL SELECT {n}, 'grades', grade, count(*) FROM gr{n} GROUP BY 3
  UNION ALL SELECT {n}, 'precision', family, round(precision, 6) FROM fp{n}
  UNION ALL SELECT {n}, 'proposals', kind, count(*) FROM (
    SELECT 'threshold' AS kind FROM pro{n} WHERE proposed <> 0.35
    UNION ALL SELECT CASE WHEN family NOT IN ({muted}) AND precision < r THEN 'mute_family' WHEN family IN ({muted}) AND precision > 2 * r THEN 'unmute_family' END FROM fp{n}, br{n} WHERE graded >= 30) WHERE kind IS NOT NULL GROUP BY 3
  UNION ALL SELECT {n}, 'detected', outcome_class, count(*) FROM new{n} {f"WHERE outcome_id NOT IN (SELECT outcome_id FROM o{n - 1})" if n > 1 else ""} GROUP BY 3
  UNION ALL SELECT {n}, 'decisions', decision, count(*) FROM dec{n} GROUP BY 3
  UNION ALL SELECT {n}, 'discovery', k, count(*) FILTER (CASE k WHEN 'surfaced' THEN new AND reason IS NULL WHEN 'updated' THEN NOT new WHEN 'rejected' THEN new AND reason IS NOT NULL ELSE new AND near END)
    FROM (SELECT reason, actor NOT IN ({f"SELECT wallet FROM cand{n - 1}" if n > 1 else "''"}) AS new, reason IS NOT NULL AND actor IN (SELECT actor FROM near{n}) AS near FROM rej{n}), (SELECT unnest(['surfaced', 'updated', 'rejected', 'rejections_recorded']) AS k) GROUP BY 3
)"""


FIRST_STORED = f"SELECT event_id AS signal_id, CASE WHEN side = 'buy' THEN 'tracked_entity_action' WHEN side = 'sell' THEN 'silent_accumulation' ELSE 'sequence_confirmation' END AS family, asset_id, NULL::VARCHAR AS wallet, us, (least(usd_value, 100) / 100)::DOUBLE AS significance, false AS delivered, 'pending' AS grade FROM ev WHERE us <= {TIMES[0]}"
NEXT_STORED = "SELECT * FROM gr1 UNION ALL SELECT '1:' || i, family, asset_id, wallet, us, significance, decision = 'delivered', 'pending' FROM dec1 WHERE decision NOT IN ('duplicate', 'threshold', 'cooldown')"
PARTS = (sql.EVENTS, sql.ASSETS, _night_sql(1, TIMES[0], FIRST_STORED), _night_sql(2, TIMES[1], NEXT_STORED))
TWO_NIGHTS = sql.with_(*PARTS).replace("WITH ", "WITH RECURSIVE ", 1)


_paths: dict = {}


def stored_signals(events):
    """A signal per click that the first night has seen."""
    family = F.when(F.col("side") == "buy", "tracked_entity_action").when(F.col("side") == "sell", "silent_accumulation").otherwise("sequence_confirmation")
    return wm.visible(events, F.lit(NIGHTS[0]).cast("timestamp")).select(F.col("event_id").alias("signal_id"), family.alias("family"), "asset_id", F.col("observed_at").alias("triggered_at"), (F.least("usd_value", F.lit(100.0)) / 100).alias("significance"))


def two(spark, sf_dir) -> nights.Nights:
    """Both nights over the clickstream, asked for once by every query. The first starts from a signal per click."""
    events, session = adapters.clickstream_events(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if session not in _paths:
        _paths[session] = tables.new_path(spark, "nights")
        tables.delete_at_exit(spark, _paths[session])
    state = nights.Nights(spark, _paths[session])
    missing = [at for at in NIGHTS if at.replace(" ", "T").replace(":", "") not in state.keys()]  # a night that is published is not even planned
    if not missing:
        return state
    with tables.scratch(spark):  # some ten steps of each night read the events, whose JSON is parsed once
        events = tables.keep(events)
        candles, assets, listed = (tables.keep(df) for df in (adapters.clickstream_candles(spark, sf_dir), adapters.assets_of(events), adapters.clickstream_listings(events)))
        for at in missing:
            nights.run_night(
                state, at, events, candles, assets, listed, nights.signals_of(stored_signals(events)), detect=qo.K, discover=DISCOVERY, wallets=qw.WALLETS, alert=ALERT, signal=qs.SIGNAL, graph=qg.GRAPH
            )
    return state


@query("two_nights", TWO_NIGHTS + "SELECT * FROM dig1 UNION ALL SELECT * FROM dig2")
def two_nights(spark, sf_dir):
    """The digests of both nights, with every section."""
    state = two(spark, sf_dir)
    night = F.when(F.col("night") == state.keys()[0], 1).otherwise(2)
    return state.read("digest", state.keys()[-1]).select(night.alias("night"), "section", "key", F.round("value", 6).alias("value"))


@query("night_decisions", TWO_NIGHTS + "SELECT 1 AS night, i AS place, family, asset_id, wallet, us, round(significance, 6) AS significance, decision FROM dec1 UNION ALL SELECT 2, i, family, asset_id, wallet, us, round(significance, 6), decision FROM dec2")
def night_decisions(spark, sf_dir):
    """What became of both nights' signals, in the order of the decisions."""
    state = two(spark, sf_dir)
    night = F.when(F.col("night") == state.keys()[0], 1).otherwise(2)
    found = state.read("decisions", state.keys()[-1])
    return found.select(night.alias("night"), F.col("place").cast("long").alias("place"), "family", "asset_id", "wallet", F.unix_micros("triggered_at").alias("us"), F.round("significance", 6).alias("significance"), "decision")


@query(
    "night_candidates",
    TWO_NIGHTS + f"""SELECT wallet, status, archetype, edge AS edge_vs_base, surfaced AS surfaced_us, coalesce(n, 0) AS n_provenance, coalesce(network, '') AS network FROM cand2 LEFT JOIN (
  SELECT actor, count(*) AS n, arg_min(split_part(asset_id, ':', 1), struct_pack(a := t0, b := outcome_id)) AS network FROM ({moved(sql.with_("o AS (SELECT * FROM o2)", qo.APPEARANCES), TIMES[1])} SELECT * FROM app) GROUP BY 1) ON actor = wallet""",
)
def night_candidates(spark, sf_dir):
    """The candidates after both nights, with what their provenance holds."""
    state = two(spark, sf_dir)
    found = state.read("candidates", state.keys()[-1])
    return found.select("wallet", "status", "archetype", "edge_vs_base", F.unix_micros("surfaced_at").alias("surfaced_us"), F.greatest(F.size("discovery_provenance"), F.lit(0)).cast("long").alias("n_provenance"), F.coalesce("network", F.lit("")).alias("network"))
