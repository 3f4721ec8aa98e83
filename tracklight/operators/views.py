"""Read views: lists and pages that a reader asks for. Their limits are what they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.schema import MUTED_FAMILIES


def signal_list(signals: DataFrame, family: str | None = None, min_significance: float = 0.0, alertable: bool = False, limit: int = 50) -> DataFrame:
    out = signals.where(F.col("significance") >= min_significance)
    if family is not None:
        out = out.where(F.col("family") == family)
    if alertable:
        out = out.where(~F.col("family").isin(*MUTED_FAMILIES))
    return out.orderBy(F.desc("triggered_at"), F.desc("significance"), "title").limit(limit)


def muted_total(signals: DataFrame) -> DataFrame:
    return signals.agg(F.count_if(F.col("family").isin(*MUTED_FAMILIES)).alias("muted_total"))


def signal_evidence(signals: DataFrame, events: DataFrame) -> DataFrame:
    """Signals with the events that speak for them, one row per event."""
    named = signals.select("family", "asset_id", "wallet", "triggered_at", F.explode("evidence_ids").alias("event_id"))
    return named.join(events.select("event_id", "actor", "event_type", F.col("observed_at").alias("event_at"), "usd_value"), "event_id")


def candidate_list(candidates: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    out = candidates if status is None else candidates.where(F.col("status") == status)
    return out.orderBy(F.desc("edge_vs_base"), "wallet").limit(limit)


def radar(candidates: DataFrame) -> DataFrame:
    return candidates.where("status IN ('tracked', 'shadow')").orderBy(F.desc("edge_vs_base"), "wallet")


def discovery_report(scores: DataFrame, least_hits: int = 2) -> DataFrame:
    """Passed actors, and those rejected in spite of several hits."""
    return scores.where(F.col("passed") | (F.col("hits") >= least_hits)).orderBy(F.desc("passed"), F.desc("edge_ratio"), "actor")


def asset_page(events: DataFrame, outcomes: DataFrame, candidates: DataFrame, asset: str, limit: int = 50) -> DataFrame:
    """The first buyers of an asset, with the archetype of tracked ones and the lead on its first outcome."""
    first = events.where((F.col("asset_id") == asset) & fn.acquired_any(F.col("side"))).groupBy("actor").agg(F.min("observed_at").alias("first_at"), F.sum("usd_value").alias("usd_value"))
    moved = outcomes.where(F.col("asset_id") == asset).agg(F.min("t0").alias("t0"))
    known = candidates.where("status IN ('tracked', 'shadow')").select(F.col("wallet").alias("actor"), "archetype")
    rows = first.join(F.broadcast(moved)).where(F.col("t0").isNull() | (F.col("first_at") < F.col("t0"))).join(known, "actor", "left")  # one row
    return rows.select("actor", "first_at", "usd_value", "archetype", fn.days_between(F.col("first_at"), F.col("t0")).alias("lead_days")).orderBy("first_at", "actor").limit(limit)


def wallet_profile(metrics: DataFrame, candidates: DataFrame, events: DataFrame, wallet: str, as_of: Column, limit: int = 100) -> DataFrame:
    """One row: the actor's metrics, its candidate status, and its last events."""
    last = events.where((F.col("actor") == wallet) & (F.col("observed_at") <= as_of)).orderBy(F.desc("observed_at"), "event_id").limit(limit)
    listed = last.groupBy("actor").agg(F.reverse(F.array_sort(F.collect_list(F.struct("observed_at", "event_id", "event_type", "asset_id", "usd_value")))).alias("last_events"))
    own = metrics.where(F.col("actor") == wallet)
    return own.join(candidates.select(F.col("wallet").alias("actor"), "status", "edge_vs_base"), "actor", "left").join(listed, "actor", "left")


def today_feed(signals: DataFrame, limit: int = 20) -> DataFrame:
    """Open signals first, then by significance; three facts and two risks of each."""
    rows = signals.orderBy(F.desc("open"), F.desc("significance"), "title").limit(limit)
    return rows.withColumn("supporting_facts", F.slice("supporting_facts", 1, 3)).withColumn("risks", F.slice("risks", 1, 2))


def top_universe(universe: DataFrame, limit: int = 300) -> DataFrame:
    return universe.orderBy(F.desc_nulls_last("volume_24h"), "asset_id").limit(limit)


def trailing_volume(candles: DataFrame, rows: int = 24) -> DataFrame:
    """Candles with the volume of the last ``rows`` candles of their asset, their own included."""
    from pyspark.sql import Window as W

    order = W.partitionBy("asset_id").orderBy("start").rowsBetween(-(rows - 1), 0)
    return candles.withColumn("trailing_volume", F.sum("volume").over(order))
