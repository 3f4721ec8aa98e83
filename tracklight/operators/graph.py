"""Lead/follow graph between actors, bounded neighbourhoods, and memberships with valid time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.lagged import lagged_pairs
from tracklight.functions.tables import keep
from tracklight.schema import DAY, GraphConfig

# What else may explain an edge, by its type.
FALSE_POSITIVES = {
    "leads": ("public copy-trading", "shared signal source", "coincidental timing"),
    "co_acquired": ("popular asset", "shared signal source"),
}


def first_acquisitions(events: DataFrame, as_of: Column) -> DataFrame:
    rows = events.where((F.col("observed_at") <= as_of) & fn.acquired_any(F.col("side")) & F.col("asset_id").isNotNull())
    return rows.groupBy("asset_id", "actor").agg(F.min("observed_at").alias("first_at"))


def edges(events: DataFrame, wallets: DataFrame, as_of: Column, config: GraphConfig = GraphConfig(), keep=keep) -> DataFrame:
    """(source, target, observations, median_lag_seconds, ordering_consistency, shared_assets, edge_type, confidence).

    Pairs are formed only within the earned wallets, and only within the largest lag. Every two blocks of actors meet in
    one task, which tells pairs with enough observations and no others; no table holds a row per observation. Of a
    pair's assets the first ``evidence_assets`` are shown.
    """
    own = first_acquisitions(events, as_of).join(wallets.select("actor").distinct(), "actor", "left_semi")
    first = keep(own.select("actor", "asset_id", F.unix_micros("first_at").alias("t")))
    found = lagged_pairs(first, int(config.max_lag_days * DAY), config.min_shared, config.evidence_assets)
    shown = ("median_lag_seconds", "shared_assets")
    edge_table = typed(found, config)
    return edge_table.select(*[c for c in edge_table.columns if c not in shown], *shown)


def pairs_of(events: DataFrame, wallets: DataFrame, as_of: Column, config: GraphConfig = GraphConfig()) -> DataFrame:
    """(source, target, asset_id, _s, _u): every asset that two of the actors first acquired within the largest lag, in order."""
    first = first_acquisitions(events, as_of).join(wallets.select("actor").distinct(), "actor", "left_semi").withColumn("_t", F.unix_micros("first_at"))
    lag = int(config.max_lag_days * DAY)
    bucket = F.floor(F.col("_t") / lag)
    source = first.select("asset_id", F.col("actor").alias("source"), F.col("_t").alias("_s"), bucket.alias("_b"))
    target = first.select("asset_id", F.col("actor").alias("target"), F.col("_t").alias("_u"), F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    ordered = (F.col("_s") < F.col("_u")) | ((F.col("_s") == F.col("_u")) & (F.col("source") < F.col("target")))
    return source.join(target, ["asset_id", "_b"]).where(ordered & (F.col("_u") - F.col("_s") <= lag)).select("source", "target", "asset_id", "_s", "_u")


def typed(found: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Edges with observations, lag and consistency, of enough observations, with their type, confidence and what else may explain them."""
    found = found.where(F.col("observations") >= config.min_shared)
    kind = F.when(F.col("ordering_consistency") >= config.lead_consistency, "leads").otherwise("co_acquired")
    modes = F.create_map(*[x for k, v in FALSE_POSITIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = found.withColumn("edge_type", kind).withColumn("confidence", fn.edge_confidence(F.col("observations"), F.col("ordering_consistency")))
    return found.withColumn("false_positive_modes", modes[F.col("edge_type")])


def upsert_edges(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` with the found edges put in the place of those of the same source, target and type."""
    key = ["source", "target", "edge_type"]
    return known.join(found.select(*key), key, "left_anti").unionByName(found.select(*known.columns))


def neighborhood(edge_table: DataFrame, wallet: str, depth: int = 1, limit: int = 200) -> DataFrame:
    """Edges within ``depth`` (1 to 3) hops of a wallet, the most confident first; each edge with its least hop."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1, 2 or 3")
    both = edge_table.select(F.col("source").alias("near"), F.col("target").alias("far")).union(edge_table.select("target", "source"))
    reached = edge_table.sparkSession.createDataFrame([(wallet, 0)], "node string, hop int")
    frontier = reached
    for hop in range(1, depth):
        frontier = frontier.join(both, frontier["node"] == both["near"]).select(F.col("far").alias("node"), F.lit(hop).alias("hop")).distinct()
        reached = reached.unionByName(frontier)
    reached = reached.groupBy("node").agg(F.min("hop").alias("hop"))
    ends = edge_table.select("*", F.explode(F.array("source", "target")).alias("node"))
    found = ends.join(reached, "node").groupBy("source", "target", "edge_type").agg(F.min("hop").alias("hop"), F.first("confidence").alias("confidence"), F.first("observations").alias("observations"))
    return found.withColumn("hop", F.col("hop") + 1).orderBy(F.desc("confidence"), "source", "target").limit(limit)


def add_members(members: DataFrame, additions: DataFrame) -> DataFrame:
    """Memberships after additions (entity_id, wallet, valid_from): none is added while one of the two is open."""
    opened = members.where("valid_to IS NULL").select("entity_id", "wallet")
    new = additions.groupBy("entity_id", "wallet").agg(F.min("valid_from").alias("valid_from")).join(opened, ["entity_id", "wallet"], "left_anti")
    return members.unionByName(new.withColumn("valid_to", F.lit(None).cast("timestamp")), allowMissingColumns=True)


def retract_members(members: DataFrame, retractions: DataFrame) -> DataFrame:
    """Open memberships that retractions (entity_id, wallet, at) name are closed; nothing is deleted."""
    ends = retractions.groupBy("entity_id", "wallet").agg(F.min("at").alias("_at"))
    closed = members.join(ends, ["entity_id", "wallet"], "left").withColumn("valid_to", F.coalesce("valid_to", "_at"))
    return closed.select(*members.columns)


def members_at(members: DataFrame, at: Column) -> DataFrame:
    return members.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def entity_of_wallets(members: DataFrame, at: Column) -> DataFrame:
    """(wallet, entity_id) at a moment; the latest membership if there are several."""
    return members_at(members, at).groupBy("wallet").agg(F.max_by("entity_id", F.struct("valid_from", "entity_id")).alias("entity_id"))


def dossier(members: DataFrame, metrics: DataFrame, notes: DataFrame) -> DataFrame:
    """Open members of every entity with their metrics and the entity's notes (entity_id, at, note) in order."""
    kept = notes.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("at", "note"))).alias("notes"))
    opened = members.where("valid_to IS NULL").join(metrics, F.col("wallet") == F.col("actor"), "left").drop("actor")
    return opened.join(kept, "entity_id", "left")


def open_members(members: DataFrame) -> DataFrame:
    return members.groupBy("entity_id").agg(F.count_if(F.col("valid_to").isNull()).alias("open_members"))
