"""Queries: lead/follow edges, neighbourhoods, memberships, playbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.functions import tables
from tracklight.operators import graph as gr
from tracklight.operators import metrics as wm
from tracklight.operators import playbooks as pb
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_wallets as qw
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY, STAGES, GraphConfig, PlaybookConfig
from tracklight.sources import adapters

GRAPH = GraphConfig(max_lag_days=2)
PLAYBOOK = PlaybookConfig(probe_ratio=0.15, window_days=10)
AT = qo.AS_OF_US

FIRST = f"fa AS (SELECT asset_id, actor, min(us) AS f FROM ev WHERE us <= {AT} AND side IN ('buy', 'long') AND asset_id IS NOT NULL GROUP BY 1, 2)"
#: Edges among the earned actors only.
EDGES = f"""
fe AS (SELECT fa.* FROM fa SEMI JOIN tr ON wallet = actor), ed AS (
  SELECT a.actor AS source, b.actor AS target, count(*) AS observations, median((b.f - a.f) / 1e6) AS median_lag_seconds, avg((b.f > a.f)::INT) AS ordering_consistency,
    CASE WHEN avg((b.f > a.f)::INT) >= 0.75 THEN 'leads' ELSE 'co_acquired' END AS edge_type, least(0.85, 0.3 + 0.1 * count(*)) * greatest(avg((b.f > a.f)::INT), 0.5) AS confidence
  FROM fe a JOIN fe b ON a.asset_id = b.asset_id AND (a.f < b.f OR (a.f = b.f AND a.actor < b.actor)) AND b.f - a.f <= {2 * DAY}
  GROUP BY 1, 2 HAVING count(*) >= 3
)"""


EDGE_PARTS = (*qo.TRACKED_PARTS, FIRST, EDGES)


def k_edges(spark, sf_dir, candidates=None):
    """The edges of the tracked actors, written once."""
    candidates = qo.tracked(spark, sf_dir) if candidates is None else candidates
    return tables.keep(gr.edges(adapters.clickstream_events(spark, sf_dir), candidates.select(F.col("wallet").alias("actor")), qo.as_of(), GRAPH))


@query("first_acquisitions", sql.with_(sql.EVENTS, FIRST) + "SELECT asset_id, actor, f AS first_us FROM fa")
def first_acquisitions(spark, sf_dir):
    return gr.first_acquisitions(adapters.clickstream_events(spark, sf_dir), qo.as_of()).select("asset_id", "actor", F.unix_micros("first_at").alias("first_us"))


@query("lead_follow_edges", sql.with_(*EDGE_PARTS) + "SELECT source, target, observations, edge_type, round(median_lag_seconds, 3) AS median_lag_seconds, round(ordering_consistency, 6) AS ordering_consistency, round(confidence, 6) AS confidence FROM ed")
def lead_follow_edges(spark, sf_dir):
    found = k_edges(spark, sf_dir)
    return found.select("source", "target", "observations", "edge_type", F.round("median_lag_seconds", 3).alias("median_lag_seconds"), F.round("ordering_consistency", 6).alias("ordering_consistency"), F.round("confidence", 6).alias("confidence"))


@query(
    "neighborhood",
    sql.with_(*EDGE_PARTS)
    + """, n1 AS (SELECT '1' AS node, 0 AS hop UNION SELECT CASE WHEN source = '1' THEN target ELSE source END, 1 FROM ed WHERE source = '1' OR target = '1'),
n AS (SELECT node, min(hop) AS hop FROM n1 GROUP BY 1)
SELECT source, target, edge_type, 1 + least(coalesce(a.hop, 9), coalesce(b.hop, 9)) AS hop, round(confidence, 6) AS confidence FROM ed LEFT JOIN n a ON a.node = source LEFT JOIN n b ON b.node = target
WHERE a.node IS NOT NULL OR b.node IS NOT NULL ORDER BY ed.confidence DESC, source, target LIMIT 200""",
)
def neighborhood(spark, sf_dir):
    return gr.neighborhood(k_edges(spark, sf_dir), "1", depth=2).select("source", "target", "edge_type", "hop", F.round("confidence", 6).alias("confidence"))


MEMBERS = f"""
mem AS (
  SELECT 'entity_' || (c_custkey % 20)::VARCHAR AS entity_id, c_custkey::VARCHAR AS wallet, c_custkey <= 20 AS is_primary, {AT} - (c_custkey % 40 + 1) * {DAY} AS valid_from,
    CASE WHEN c_custkey % 5 = 0 THEN {AT} - (c_custkey % 7) * {DAY} END AS valid_to FROM customer
)"""


def members(spark, sf_dir):
    """Customers as members of twenty entities; every fifth membership has ended."""
    key = F.col("c_custkey")
    return adapters.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("entity_"), (key % 20).cast("string")).alias("entity_id"), key.cast("string").alias("wallet"), (key <= 20).alias("is_primary"),
        F.timestamp_micros(F.lit(AT) - (key % 40 + 1) * DAY).alias("valid_from"), F.when(key % 5 == 0, F.timestamp_micros(F.lit(AT) - (key % 7) * DAY)).alias("valid_to"),
    )


@query("members_at", sql.with_(MEMBERS) + f"SELECT entity_id, wallet FROM mem WHERE valid_from <= {AT - 5 * DAY} AND (valid_to IS NULL OR valid_to > {AT - 5 * DAY})")
def members_at(spark, sf_dir):
    return gr.members_at(members(spark, sf_dir), F.timestamp_micros(F.lit(AT - 5 * DAY))).select("entity_id", "wallet")


@query("membership_changes", sql.with_(MEMBERS) + f"""
, add AS (SELECT 'entity_' || (c_custkey % 20)::VARCHAR AS entity_id, c_custkey::VARCHAR AS wallet, {AT} AS valid_from FROM customer WHERE c_custkey % 3 = 0),
m2 AS (SELECT entity_id, wallet, valid_from, valid_to FROM mem UNION ALL SELECT entity_id, wallet, valid_from, NULL FROM add a WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.entity_id = a.entity_id AND m.wallet = a.wallet AND m.valid_to IS NULL))
SELECT entity_id, wallet, valid_from, CASE WHEN valid_to IS NULL AND wallet::BIGINT % 7 = 0 THEN {AT + DAY} ELSE valid_to END::VARCHAR AS valid_to FROM m2""")  # fmt: skip
def membership_changes(spark, sf_dir):
    key = F.col("c_custkey")
    customers = adapters.read(spark, sf_dir, "customer").select(F.concat(F.lit("entity_"), (key % 20).cast("string")).alias("entity_id"), key.cast("string").alias("wallet"), "c_custkey")
    added = customers.where(key % 3 == 0).select("entity_id", "wallet", qo.as_of().alias("valid_from"))
    gone = customers.where(key % 7 == 0).select("entity_id", "wallet", F.timestamp_micros(F.lit(AT + DAY)).alias("at"))
    after = gr.retract_members(gr.add_members(members(spark, sf_dir).drop("is_primary"), added), gone)
    return after.select("entity_id", "wallet", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").cast("string").alias("valid_to"))


@query("open_members", sql.with_(MEMBERS) + "SELECT entity_id, count(*) FILTER (valid_to IS NULL) AS open_members FROM mem GROUP BY 1")
def open_members(spark, sf_dir):
    return gr.open_members(members(spark, sf_dir))


@query(
    "dossier",
    sql.with_(sql.EVENTS, MEMBERS, qw.SEEN, qw.ACTIVITY)
    + "SELECT entity_id, wallet, total_actions, distinct_tokens, n.n_notes FROM mem LEFT JOIN act ON actor = wallet LEFT JOIN (SELECT 'entity_' || (n_nationkey % 20)::VARCHAR AS entity_id, count(*) AS n_notes FROM nation GROUP BY 1) n USING (entity_id) WHERE valid_to IS NULL",
)
def dossier(spark, sf_dir):
    key = F.col("n_nationkey")
    notes = adapters.read(spark, sf_dir, "nation").select(F.concat(F.lit("entity_"), (key % 20).cast("string")).alias("entity_id"), key.alias("at"), F.col("n_name").alias("note"))
    found = gr.dossier(members(spark, sf_dir), wm.activity(qw.seen(spark, sf_dir)), notes)
    return found.select("entity_id", "wallet", "total_actions", "distinct_tokens", F.size("notes").cast("long").alias("n_notes"))


def _stages(median_keys: str) -> str:
    return f"""
me AS (SELECT e.*, entity_id, is_primary FROM e JOIN mem ON wallet = actor),
md AS (SELECT me.*, coalesce(median(usd_value) OVER (PARTITION BY {median_keys}), 0) AS med FROM me),
st0 AS (SELECT *, CASE WHEN event_type = 'order_placed' AND NOT filled THEN 'bidding' WHEN event_type IN ('liquidation', 'position_closed') THEN 'aborted'
    WHEN acquired THEN CASE WHEN med > 0 AND coalesce(usd_value, 0) < med * 0.15 THEN 'probing' ELSE 'accumulating' END WHEN event_type = 'swap' AND side = 'sell' THEN 'distributing' END AS stage0 FROM md),
st AS (SELECT *, CASE WHEN stage0 = 'accumulating' AND NOT is_primary THEN 'confirming' ELSE stage0 END AS stage FROM st0 WHERE stage0 IS NOT NULL AND asset_id IS NOT NULL)"""


SEQ = f"""
fs AS (SELECT entity_id, asset_id, stage, min(us) AS us, arg_min(event_id, struct_pack(a := us, b := event_id)) AS eid, count(*) AS n FROM st GROUP BY ALL),
en AS (SELECT asset_id, min(t0) AS t0 FROM o WHERE seen <= {AT} AND outcome_class IN ('price_run', 'cex_listing', 'revival') GROUP BY 1),
sq AS (
  SELECT entity_id, fs.asset_id, string_agg(stage, '>' ORDER BY us, eid) AS stages, sum(n)::BIGINT AS observations, any_value(t0) AS t0, bool_or(t0 IS NOT NULL) AS completed, bool_or(t0 IS NULL AND stage = 'aborted') AS aborted
  FROM fs LEFT JOIN en ON en.asset_id = fs.asset_id GROUP BY 1, 2
)"""
SEQ_PARTS = (*qo.BASE, qw.SEEN, MEMBERS, _stages("entity_id"), SEQ)


def k_sequences(spark, sf_dir):
    staged = pb.staged_events(adapters.clickstream_events(spark, sf_dir), members(spark, sf_dir), qo.as_of(), PLAYBOOK)
    return pb.sequences(staged, qo.k_outcomes(spark, sf_dir), qo.as_of())


@query("sequences", sql.with_(*SEQ_PARTS) + "SELECT entity_id, asset_id, stages, observations, t0::VARCHAR AS t0, completed, aborted FROM sq")
def sequences(spark, sf_dir):
    return k_sequences(spark, sf_dir).select("entity_id", "asset_id", F.array_join("stages", ">").alias("stages"), "observations", F.unix_micros("outcome_t0").cast("string").alias("t0"), "completed", "aborted")


@query(
    "playbook",
    sql.with_(*SEQ_PARTS)
    + f""", tot AS (SELECT entity_id, count(*) FILTER (completed) AS supporting, count(*) FILTER (aborted) AS aborted_sequences FROM sq GROUP BY 1 HAVING count(*) FILTER (completed) >= 3),
ps AS (SELECT fs.entity_id, stage, count(*) AS n, round(median((sq.t0 - fs.us) / {DAY}.0), 2) AS lag FROM fs JOIN sq ON sq.entity_id = fs.entity_id AND sq.asset_id = fs.asset_id WHERE completed GROUP BY 1, 2)
SELECT entity_id, supporting, aborted_sequences, coalesce(string_agg(stage, '>' ORDER BY list_position({list(STAGES)}, stage)) FILTER (n >= supporting * 0.5 AND stage <> 'aborted'), '') AS stages,
  round(sum(lag), 2) AS total_lag FROM tot JOIN ps USING (entity_id) GROUP BY ALL""",
)
def playbook(spark, sf_dir):
    books = pb.playbooks(k_sequences(spark, sf_dir), PLAYBOOK)
    total = F.aggregate(F.map_values("median_stage_lags"), F.lit(0.0), lambda a, x: a + x)
    return books.select("entity_id", "supporting", "aborted_sequences", F.array_join("stages", ">").alias("stages"), F.round(total, 2).alias("total_lag"))


@query(
    "current_stage",
    sql.with_(sql.EVENTS, f"e AS (SELECT * FROM ev WHERE us <= {AT} AND us >= {AT - 10 * DAY})", MEMBERS, _stages("entity_id, asset_id"))
    + f"SELECT entity_id, asset_id, arg_max(stage, struct_pack(a := us, b := event_id)) AS stage, coalesce(list_position({list(STAGES)}, arg_max(stage, struct_pack(a := us, b := event_id))), 0)::INTEGER AS stage_index, max(us) AS entered_us FROM st GROUP BY 1, 2",
)
def current_stage(spark, sf_dir):
    found = pb.current_stages(adapters.clickstream_events(spark, sf_dir), members(spark, sf_dir), qo.as_of(), PLAYBOOK)
    return found.select("entity_id", "asset_id", "stage", "stage_index", F.unix_micros("entered_at").alias("entered_us"))
