"""Merges into stored tables. Each returns the table after the merge; writing goes to a new path that replaces the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.temporal import range_join
from tracklight.schema import DAY, EVENT_TYPES, FINALITIES


def problem(columns: list[str]) -> Column:
    """Why a raw event row cannot be stored; null if it can."""
    checks = [
        ("event_id", F.col("event_id").isNull(), "no event id"),
        ("actor", F.col("actor").isNull() | (F.col("actor") == ""), "no actor"),
        ("observed_at", F.col("observed_at").isNull(), "no observation time"),
        ("event_type", ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "unknown event type"),
        ("finality", ~F.coalesce(F.col("finality").isin(*FINALITIES), F.lit(False)), "unknown finality"),
        ("usd_value", F.col("usd_value") < 0, "negative value"),
    ]
    return F.coalesce(*[F.when(bad, reason) for name, bad, reason in checks if name in columns])


def split_dead_letters(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(storable rows, dead letters with ``error``): a bad row never stops its batch."""
    marked = batch.withColumn("error", problem(batch.columns))
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def upsert_events(stored: DataFrame, batch: DataFrame, sequence: str = "observed_at") -> DataFrame:
    """Stored events after a batch: new ids are added as first seen; of known ids only the finality changes, to the
    last that the batch says. One shuffle by id; an id that fills the batch is first reduced within each task.
    """
    first = F.min_by(F.struct(*batch.columns), F.struct(sequence, "finality"))
    per_id = batch.groupBy("event_id").agg(first.alias("_new"), F.max_by("finality", F.struct(sequence, "finality")).alias("_finality"), F.count(F.lit(1)).alias("_n"))
    both = stored.withColumn("_stored", F.lit(True)).join(per_id, "event_id", "full_outer")
    columns = [
        F.coalesce("_finality", "finality").alias(c) if c == "finality" else F.col(c) if c == "event_id" else F.when(F.col("_stored"), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c)
        for c in stored.columns
    ]
    return both.select(*columns)


def upsert_counts(stored: DataFrame, batch: DataFrame, sequence: str = "observed_at") -> DataFrame:
    """(seen, written, duplicates, reverted) of a batch against what is stored."""
    known = stored.select("event_id", F.col("finality").alias("_was"))
    per_id = batch.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("finality", F.struct(sequence, "finality")).alias("finality")).join(known, "event_id", "left")
    new = F.col("_was").isNull()
    reverted = (F.col("finality") == "reverted") & (new | (F.col("_was") != "reverted"))
    return per_id.agg(F.sum("n").alias("seen"), F.count_if(new).alias("written"), F.sum(F.col("n") - new.cast("int")).alias("duplicates"), F.count_if(reverted).alias("reverted"))


def asset_dimension(stored: DataFrame, events: DataFrame) -> DataFrame:
    """(asset_id, network, address, symbol, decimals, first_seen_at) after events: the first symbol and decimals stay, the earliest moment counts."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chain_time")))
    seen = events.where("asset_id IS NOT NULL").groupBy("asset_id").agg(F.min("chain_time").alias("_first"), known("symbol").alias("_symbol"), known("decimals").alias("_decimals"))
    both = stored.join(seen, "asset_id", "full_outer")
    return both.select(
        "asset_id", F.split_part("asset_id", F.lit(":"), F.lit(1)).alias("network"), fn.asset_address(F.col("asset_id")).alias("address"), F.coalesce("symbol", "_symbol").alias("symbol"),
        F.coalesce("decimals", "_decimals").alias("decimals"), F.least("first_seen_at", "_first").alias("first_seen_at"),
    )


def register_assets(stored: DataFrame, pools: DataFrame) -> DataFrame:
    """Pools (asset_id, symbol, created_at, first_candle) that the dimension lacks, losers too, are added."""
    new = pools.groupBy("asset_id").agg(F.min("symbol").alias("symbol"), F.min(F.coalesce("created_at", "first_candle")).alias("first_seen_at")).join(stored.select("asset_id"), "asset_id", "left_anti")
    return stored.unionByName(new)


def merge_universe(*sources: DataFrame) -> DataFrame:
    """Assets of several listings (asset_id, ...), each as its first source has it."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    order = W.partitionBy("asset_id").orderBy("_rank", *[c for c in sources[0].columns if c != "asset_id"])
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_rank")


def tradable(candles: DataFrame, peak_volume: float = 50_000.0, dead_share: float = 0.05) -> DataFrame:
    """(asset_id, peak_volume, last_volume, dead): assets that could be traded once; dead ones stay in the universe."""
    found = candles.groupBy("asset_id").agg(F.max("volume").alias("peak_volume"), F.max_by("volume", "start").alias("last_volume"))
    return found.where(F.col("peak_volume") >= peak_volume).withColumn("dead", F.col("last_volume") < dead_share * F.col("peak_volume"))


def above_floors(universe: DataFrame, liquidity: float | None = 15_000.0, volume: float = 2_000_000.0) -> DataFrame:
    out = universe.where(F.coalesce("volume_24h", F.lit(0.0)) >= volume)
    return out if liquidity is None else out.where(F.coalesce("liquidity_usd", F.lit(0.0)) >= liquidity)


def suspects(events: DataFrame, outcomes: DataFrame, days: int = 30, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(actors, (found, taken) counts): who bought in the days before any outcome; all of them, or the first ``limit`` by name."""
    spans = outcomes.select("asset_id", (F.unix_micros("t0") - days * DAY).alias("_start"), F.unix_micros("t0").alias("_end"))
    bought = events.where((F.col("event_type") == "swap") & fn.bought(F.col("side"))).select("actor", "asset_id", F.unix_micros("observed_at").alias("_at"))
    actors = range_join(bought, spans, ["asset_id"], "_at", "_start", "_end", bucket=days * DAY).select("actor").distinct()
    counts = actors.agg(F.count(F.lit(1)).alias("found"))
    if limit is None:
        return actors, counts.withColumn("taken", F.col("found"))
    return actors.orderBy("actor").limit(limit), counts.withColumn("taken", F.least("found", F.lit(limit).cast("long")))


def full_history(events: DataFrame, actors: DataFrame) -> DataFrame:
    return events.join(actors.select("actor").distinct(), "actor", "left_semi")


def append(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)
