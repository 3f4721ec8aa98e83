"""Metrics of all actors at a point in time, and their archetypes.

Every function takes an already scanned event table and works on all actors at once: one aggregation per aspect,
joined by actor. ``as_of`` is a column or literal; events and outcomes seen later do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.medians import medians
from tracklight.functions.tables import keep
from tracklight.functions.temporal import counts_before, next_after, sums_before
from tracklight.operators import outcomes as oc
from tracklight.schema import HOUR, PREDICTIVE, WalletConfig

CLASSES = (*PREDICTIVE, "rug_or_collapse")


def visible(events: DataFrame, as_of: Column, lookback_days: float | None = None) -> DataFrame:
    seen = events.where(F.col("observed_at") <= as_of)
    if lookback_days is not None:
        seen = seen.where(F.unix_micros("observed_at") >= F.unix_micros(as_of) - int(lookback_days * 24 * HOUR))
    return seen


def _acquired() -> Column:
    return fn.acquired_for_metrics(F.col("event_type"), F.col("side"))


def activity(events: DataFrame, sized: bool = False) -> DataFrame:
    """Counts and rates per actor; with ``sized``, the columns of ``sizes`` too."""
    token = F.when(_acquired(), F.col("asset_id"))
    first, last = F.min("observed_at"), F.max("observed_at")
    found = events.groupBy("actor").agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count_if(_acquired()).alias("acquisitions"),
        F.countDistinct(token).alias("distinct_tokens"),
        F.countDistinct(F.to_date("observed_at")).alias("active_days"),
        F.countDistinct(F.hour("observed_at")).alias("distinct_active_hours"),
        fn.months_between(first, last).alias("months"),
        F.count_if(fn.is_resting(F.col("event_type"), F.col("filled"))).alias("resting_orders"),
        F.count_if(F.col("event_type") == "liquidation").alias("liquidations"),
        *([F.max("usd_value").alias("max_position_usd")] if sized else []),
    )
    if sized:
        found = found.join(medians(events, ["actor"], {"median_position_usd": F.col("usd_value")}), "actor", "left")
    return found.select("*", (F.col("total_actions") / F.col("months")).alias("trades_per_month"), (F.col("distinct_tokens") / F.col("months")).alias("tokens_per_month")).drop("months")


def sizes(events: DataFrame) -> DataFrame:
    """Exact median and maximum of position sizes."""
    largest = events.where("usd_value IS NOT NULL").groupBy("actor").agg(F.max("usd_value").alias("max_position_usd"))
    return largest.join(medians(events, ["actor"], {"median_position_usd": F.col("usd_value")}), "actor")


def size_shares(events: DataFrame) -> DataFrame:
    """``events`` with ``size_share``: which share of the actor's sizes is not above this one; null without a size."""
    mine = W.partitionBy("actor")
    not_above = F.count("usd_value").over(mine.orderBy("usd_value").rangeBetween(W.unboundedPreceding, 0))
    return events.withColumn("size_share", F.when(F.col("usd_value").isNotNull(), not_above / F.count("usd_value").over(mine)))


def acquisitions(events: DataFrame) -> DataFrame:
    """What the steps about entries read of the events: acquisitions of any kind, with their marks."""
    marks = {"acquired": _acquired(), "bought": fn.bought(F.col("side")), "acquired_any": fn.acquired_any(F.col("side"))}
    rows = events.where(F.col("asset_id").isNotNull()).select("event_id", "actor", "asset_id", "chain_time", "observed_at", "usd_value", *[m.alias(n) for n, m in marks.items()])
    return rows.where("acquired OR bought OR acquired_any")


def entry_latency(events: DataFrame, creations: DataFrame, config: WalletConfig = WalletConfig()) -> DataFrame:
    """How soon after an asset's creation each actor acquired it; assets of unknown creation are left out.

    ``creations`` holds token_created events, whenever they were observed.
    """
    return entry_latency_of(acquisitions(events), creations, config)


def entry_latency_of(acquired: DataFrame, creations: DataFrame, config: WalletConfig = WalletConfig()) -> DataFrame:
    created = creations.where("event_type = 'token_created'").groupBy("asset_id").agg(F.min("chain_time").alias("created_at"))
    late = (F.unix_micros("chain_time") - F.unix_micros("created_at")) / 1e6
    rows = acquired.where("acquired").join(created, "asset_id").select("actor", late.alias("latency")).where("latency >= 0")
    return rows.groupBy("actor").agg(F.min("latency").alias("min_entry_latency_seconds"), F.count_if(F.col("latency") <= config.sniper_seconds).alias("sniper_entries"))


def _turns(events: DataFrame) -> DataFrame:
    """One row per actor, asset and turn, which ends with a sale: its first purchase, its end, and its money by block.

    ``_turn`` counts all sales of the asset before, ``_block`` those with a size; both are counted in pieces of time.
    """
    sell, bought, priced = F.coalesce(F.col("side") == "sell", F.lit(False)), fn.bought(F.col("side")), F.col("usd_value").isNotNull()
    rows = events.where("asset_id IS NOT NULL").select("actor", "asset_id", "event_id", "observed_at", "side", "event_type", "usd_value")
    placed = counts_before(rows, ["actor", "asset_id"], ["observed_at", "event_id"], {"_turn": sell, "_block": sell & priced})
    fell = ~bought & (F.col("event_type") == "liquidation")
    return placed.groupBy("actor", "asset_id", "_block", "_turn").agg(
        F.min(F.when(bought, F.col("observed_at"))).alias("opened_at"), F.min(F.when(sell, F.col("observed_at"))).alias("closed_at"),
        F.sum(F.when(bought, F.col("usd_value"))).alias("_paid"), F.sum(F.when(sell, F.col("usd_value"))).alias("_sale"),
        F.sum(F.when(fell & ~sell, F.col("usd_value"))).alias("_lost"), F.sum(F.when(fell & sell, F.col("usd_value"))).alias("_lost_sale"), F.count("usd_value").alias("_priced"),
    )


def _hours() -> Column:
    return F.when(F.col("opened_at").isNotNull(), fn.hours_between(F.col("opened_at"), F.col("closed_at")))


def _gains(turns: DataFrame) -> DataFrame:
    """``turns`` with gain: sales less what the block paid, less liquidations; null in turns without any size."""
    none = F.lit(0.0)
    turns = turns.withColumn("_spent", F.coalesce(F.sum("_paid").over(W.partitionBy("actor", "asset_id", "_block")), none))
    sold = F.when(F.col("_spent") > 0, F.coalesce(F.col("_sale") - F.col("_spent"), none)).otherwise(-F.coalesce("_lost_sale", none))
    return turns.withColumn("gain", F.when(F.col("_priced") > 0, sold - F.coalesce("_lost", none)))


def holds(events: DataFrame) -> DataFrame:
    """(actor, closed_at, hours): from each first open purchase of an asset to the next sale."""
    return _turns(events).select("actor", "closed_at", _hours().alias("hours")).where("hours IS NOT NULL")


def hold_hours(events: DataFrame) -> DataFrame:
    """Median hours from the first open purchase of an asset to the next sale."""
    held = holds(events)
    return held.groupBy("actor").agg(F.count(F.lit(1)).alias("episodes_closed")).join(medians(held, ["actor"], {"median_hold_hours": F.col("hours")}), "actor")


def realized_pnl(events: DataFrame) -> DataFrame:
    """Sales less what was spent since the last sale, less liquidations. For display; no ranking reads it."""
    return _gains(_turns(events)).where("gain IS NOT NULL").groupBy("actor").agg(F.sum("gain").alias("realized_pnl_usd"))


def holding(events: DataFrame, keep=keep) -> DataFrame:
    """``hold_hours`` and ``realized_pnl`` of every actor that has either, from one table of its turns."""
    turns = keep(_gains(_turns(events)).select("actor", _hours().alias("hours"), "gain"))
    sums = turns.groupBy("actor").agg(F.count("hours").alias("episodes_closed"), F.sum("gain").alias("realized_pnl_usd"))
    return sums.join(medians(turns, ["actor"], {"median_hold_hours": F.col("hours")}), "actor", "left")


def precision(events: DataFrame, outcomes: DataFrame, rates: DataFrame, config: WalletConfig = WalletConfig()) -> DataFrame:
    """(actor, outcome_class, hits, trials, hit_rate, shrunk_hit_rate, base_rate, edge_ratio): per asset, not per trade.

    A hit is an asset first acquired before some outcome of the class became public.
    """
    return precision_of(acquisitions(events), outcomes, rates, config)


def precision_of(acquired: DataFrame, outcomes: DataFrame, rates: DataFrame, config: WalletConfig = WalletConfig()) -> DataFrame:
    touched = acquired.where("acquired").groupBy("actor", "asset_id").agg(F.min("observed_at").alias("entry"))
    latest = outcomes.where(F.col("outcome_class").isin(*CLASSES)).groupBy("asset_id").pivot("outcome_class", list(CLASSES)).agg(F.max("t0"))
    joined = touched.join(latest, "asset_id", "left")
    per_actor = joined.groupBy("actor").agg(F.count(F.lit(1)).alias("trials"), *[F.count_if(F.col("entry") < F.col(c)).alias(c) for c in CLASSES])
    long = per_actor.select("actor", "trials", F.explode(F.array(*[F.struct(F.lit(c).alias("outcome_class"), F.col(c).alias("hits")) for c in CLASSES])).alias("h")).select("actor", "trials", "h.*")
    based = long.join(F.broadcast(rates.select("outcome_class", F.col("rate").alias("base_rate"))), "outcome_class")  # one row per class
    shrunk = fn.shrink(F.col("hits"), F.col("trials"), F.col("base_rate"), config.prior)
    based = based.select("actor", "outcome_class", "hits", "trials", (F.col("hits") / F.col("trials")).alias("hit_rate"), shrunk.alias("shrunk_hit_rate"), "base_rate")
    return based.withColumn("edge_ratio", F.when(F.col("base_rate") > 0, F.col("shrunk_hit_rate") / F.col("base_rate")).otherwise(0.0))


def earliness(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Median lead in days, and median rank among the buyers before the move, over acquisitions that an outcome followed."""
    return earliness_of(acquisitions(events), outcomes)


def earliness_of(acquired: DataFrame, outcomes: DataFrame) -> DataFrame:
    later = outcomes.where(F.col("outcome_class").isin(*PREDICTIVE)).select("asset_id", "t0", F.col("t0").alias("_t0"))
    entries = acquired.where("acquired").select("actor", "asset_id", F.col("observed_at").alias("at"))
    led = next_after(entries, later, "at", "_t0", ["asset_id"], ["t0"]).where(F.col("t0").isNotNull())
    # the rank of an entry: distinct buyers who came before it, of those who came before the move; both are counts along the asset's time
    buyers = acquired.where("bought").groupBy("asset_id", "actor").agg(F.min("observed_at").alias("at"))
    none = lambda t: F.lit(None).cast(t)
    marks = (
        buyers.select("asset_id", "at", F.lit(1).alias("buyer"), none("string").alias("actor"), none("timestamp").alias("t0"), F.lit(0).alias("kind"))
        .unionByName(led.select("asset_id", "at", F.lit(0).alias("buyer"), "actor", "t0", F.lit(1).alias("kind")))
        .unionByName(led.select("asset_id", "t0").distinct().select("asset_id", F.col("t0").alias("at"), F.lit(0).alias("buyer"), none("string").alias("actor"), "t0", F.lit(2).alias("kind")))
    )
    counted = sums_before(marks, ["asset_id"], "at", "buyer", "before")
    moves = counted.where("kind = 2").select("asset_id", "t0", F.col("before").alias("buyers"))
    ranked = counted.where("kind = 1").join(moves, ["asset_id", "t0"])
    rank = F.when(F.col("buyers") > 0, F.col("before") / F.col("buyers")).otherwise(1.0)
    return medians(ranked, ["actor"], {"median_lead_days": fn.days_between(F.col("at"), F.col("t0")), "median_buyer_rank": rank})


def archetype(config: WalletConfig = WalletConfig()) -> Column:
    """struct(archetype, confidence, reason) of a row of ``wallet_metrics``. Exclusions come before any performance."""
    c = F.col

    def verdict(name: str, confidence, reason=None) -> Column:
        return F.struct(
            F.lit(name).alias("archetype"),
            (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).cast("double").alias("confidence"),
            (reason if reason is not None else F.lit(None)).cast("string").alias("reason"),
        )

    cascade = [
        (c("sniper_entries") >= config.sniper_entries, verdict("bot", 0.95, F.format_string(f"entered_within_{config.sniper_seconds:.0f}s_of_launch_%d_times", c("sniper_entries")))),
        ((c("distinct_active_hours") >= config.active_hours) & (c("total_actions") > config.active_actions), verdict("bot", 0.8, F.lit("active_around_the_clock"))),
        (
            (c("trades_per_month") > config.most_trades_per_month) | (c("tokens_per_month") > config.most_tokens_per_month),
            verdict("high_frequency", 0.85, F.format_string("churn_%.1f_trades_per_month", c("trades_per_month"))),
        ),
        (c("distinct_tokens") < config.least_tokens, verdict("unclassified", 0.0, F.format_string("sample_size_%d_below_minimum", c("distinct_tokens")))),
        (c("collapse_share") >= config.collapse_share, verdict("pump_operator", F.least(F.lit(0.95), c("collapse_share")))),
        ((c("hit_rate")["cex_listing"] >= config.listing_rate) & (c("hits")["cex_listing"] >= 3), verdict("listing_predictor", F.least(F.lit(0.95), c("shrunk_hit_rate")["cex_listing"]))),
        ((c("hit_rate")["revival"] >= config.revival_rate) & (c("hits")["revival"] >= 3), verdict("revival_specialist", F.least(F.lit(0.95), c("hit_rate")["revival"]))),
        (
            (c("trades_per_month") <= config.quiet_trades_per_month) & (c("shrunk_hit_rate")["price_run"] >= config.quiet_shrunk) & (c("edge_ratio")["price_run"] >= config.quiet_edge),
            verdict("informed_accumulator", F.least(F.lit(0.9), c("shrunk_hit_rate")["price_run"])),
        ),
    ]
    out = verdict("unclassified", 0.0)
    for condition, value in reversed(cascade):
        out = F.when(condition, value).otherwise(out)
    return out


def wallet_metrics(
    events: DataFrame, outcomes: DataFrame, assets: DataFrame, as_of: Column, lookback_days: float | None = None, config: WalletConfig = WalletConfig(), acquired: DataFrame | None = None, keep=keep
) -> DataFrame:
    """One row per actor: activity, sizes, latency, holding, P&L, precision maps, earliness and archetype.

    The events are read for the activity, for the trades, for creations, and for the acquisitions, which are kept
    unless the caller has them (``acquired``). ``outcomes`` should be a stored table.
    """
    seen, known = visible(events, as_of, lookback_days), outcomes.where(F.col("first_observed_at") <= as_of)
    acquired = visible(keep(acquisitions(events)) if acquired is None else acquired, as_of, lookback_days)
    rates = keep(oc.base_rates(known, assets, as_of, CLASSES))
    long = precision_of(acquired, known, rates, config)
    names = ("hits", "hit_rate", "shrunk_hit_rate", "base_rate", "edge_ratio")
    maps = long.groupBy("actor").agg(*[F.map_from_entries(F.collect_list(F.struct("outcome_class", n))).alias(n) for n in names])
    out = activity(seen, sized=True)
    for part in (entry_latency_of(acquired, events, config), holding(seen, keep), maps, earliness_of(acquired, known)):
        out = out.join(part, "actor", "left")
    out = out.withColumns({"sniper_entries": F.coalesce("sniper_entries", F.lit(0)), "collapse_share": F.coalesce(F.col("hit_rate")["rug_or_collapse"], F.lit(0.0))})
    # actors that acquired nothing have no precision rows, and fall under the least sample
    return out.withColumn("_v", archetype(config)).select("*", "_v.archetype", F.col("_v.confidence").alias("archetype_confidence"), F.col("_v.reason").alias("excluded_reason")).drop("_v")
