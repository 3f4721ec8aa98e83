"""Backtests: simulated fills and exits from candles, equity, a random baseline, and an audit for look-ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions.tables import dense_index, keep
from tracklight.functions.temporal import asof_join
from tracklight.schema import DAY, PREDICTIVE, BacktestConfig


def prices_at(points: DataFrame, candles: DataFrame, at: str, price: str, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """``points`` with the close of the last candle that starts by column ``at`` (microseconds); null without one."""
    right = candles.select("asset_id", F.unix_micros("start").alias(at), F.col("close").alias(price), F.unix_micros("start").alias("_start"))
    found = asof_join(points, right, at, ["asset_id"], [price, "_start"], bucket=30 * DAY)
    if config.max_staleness_days is not None:
        fresh = F.col(at) - F.col("_start") <= int(config.max_staleness_days * DAY)
        found = found.withColumn(price, F.when(fresh, F.col(price)))
    return found.drop("_start")


def fills(entries: DataFrame, candles: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Entries (entry_id, asset_id, signal_at) with fill_us, fill_price, fees_usd and rejected_reason."""
    timed = entries.withColumn("fill_us", F.unix_micros("signal_at") + config.delay_seconds * 1_000_000)
    priced = prices_at(timed, candles, "fill_us", "_price", config)
    ok = F.coalesce(F.col("_price") > 0, F.lit(False))
    return priced.select(
        *entries.columns, "fill_us", F.when(ok, F.col("_price") * (1 + config.slippage_bps / 10_000)).alias("fill_price"),
        F.when(ok, F.lit(config.size_usd * config.fee_bps / 10_000)).alias("fees_usd"), F.when(~ok, "no_price_at_entry").alias("rejected_reason"),
    )


def returns(filled: DataFrame, candles: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Filled entries with pnl_usd and ret; an asset without an exit price is a total loss."""
    held = filled.where("rejected_reason IS NULL").withColumn("exit_us", F.col("fill_us") + int(config.hold_days * DAY))
    priced = prices_at(held, candles, "exit_us", "exit_price", config)
    gross = (F.coalesce("exit_price", F.lit(0.0)) - F.col("fill_price")) / F.col("fill_price")
    pnl = config.size_usd * gross - F.col("fees_usd")
    return priced.select("*", pnl.alias("pnl_usd"), (pnl / config.size_usd).alias("ret"))


def equity(trades: DataFrame) -> DataFrame:
    """Trades with running equity, peak and drawdown in the order of entries.

    Running sums are taken per day first, so that no task sorts all trades: a day's trades are ordered together,
    and the days' totals, one row each, carry over.
    """
    day = F.floor(F.col("fill_us") / DAY)
    by_day = W.partitionBy("_day").orderBy("fill_us", "entry_id").rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumn("_day", day)
    rows = rows.withColumn("_in", F.sum("pnl_usd").over(by_day))
    rows = rows.withColumn("_high", F.max("_in").over(by_day))
    days = rows.groupBy("_day").agg(F.sum("pnl_usd").alias("_sum"), F.max("_in").alias("_top"))
    over = W.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    days = days.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_before") + F.col("_top")).over(over), F.lit(0.0))))
    joined = rows.join(days.select("_day", "_before", "_peak"), "_day")
    value, peak = F.col("_before") + F.col("_in"), F.greatest("_peak", F.col("_before") + F.col("_high"))
    return joined.select(*trades.columns, value.alias("equity"), peak.alias("peak"), (value - peak).alias("drawdown"))


def summary(filled: DataFrame, trades: DataFrame) -> DataFrame:
    """One row: trades, rejected, wins, hit rate, median, mean, worst and best return, total and deepest drawdown."""
    rejected = filled.agg(F.count_if(F.col("rejected_reason").isNotNull()).alias("rejected"))
    won = F.count_if(F.col("ret") > 0)
    found = equity(trades).agg(
        F.count(F.lit(1)).alias("trades"), won.alias("wins"), (won / F.count(F.lit(1))).alias("hit_rate"), F.median("ret").alias("median_return"), F.avg("ret").alias("mean_return"),
        F.min("ret").alias("worst_return"), F.max("ret").alias("best_return"), F.sum("pnl_usd").alias("total_return_usd"), F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"),
    )
    return found.join(F.broadcast(rejected))  # one row each


def _draw(*parts) -> Column:
    """A whole number from 0 to 2 ** 32 - 1 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def random_entries(assets: DataFrame, n: int, start: Column, end: Column, seed: int = 7) -> DataFrame:
    """``n`` entries (entry_id, asset_id, signal_at): random assets known by ``end``, at random times in the first 60 % of the span.

    Each draw takes a number of the assets, which are numbered without gaps, so every draw finds its asset and every
    asset can be drawn; without assets there are no entries.
    """
    known = assets.where(F.col("first_seen_at") <= end).select("asset_id").distinct()
    indexed = dense_index(known, [_draw(seed, "order", F.col("asset_id")), F.col("asset_id")], "_slot")
    total = indexed.count()
    draws = assets.sparkSession.range(n).select(F.col("id").alias("entry_id"), F.floor(_draw(seed, "asset", F.col("id").cast("string")) * F.lit(total) / F.lit(1 << 32)).alias("_slot"), (_draw(seed, "time", F.col("id").cast("string")) % 1_000_000).alias("_u"))
    span = (F.unix_micros(end) - F.unix_micros(start)) * 0.6
    at = F.timestamp_micros((F.unix_micros(start) + F.floor(span * F.col("_u") / 1_000_000)).cast("long"))
    return draws.join(indexed, "_slot").select("entry_id", "asset_id", at.alias("signal_at"))


def leakage_audit(events: DataFrame, outcomes: DataFrame, assets: DataFrame, end: Column) -> DataFrame:
    """(check_name, passed, bad): outcomes or events seen before they happened, a universe of winners, no events."""
    early_outcomes = outcomes.agg(F.count_if(F.col("first_observed_at") < F.col("t0")).alias("bad")).select(F.lit("outcome_first_observed_at_not_before_t0").alias("check_name"), (F.col("bad") == 0).alias("passed"), "bad")
    early_events = events.agg(F.count_if(F.col("observed_at") < F.col("chain_time")).alias("bad")).select(F.lit("event_observed_at_not_before_chain_time").alias("check_name"), (F.col("bad") == 0).alias("passed"), "bad")
    winners = outcomes.where(F.col("outcome_class").isin(*PREDICTIVE)).agg(F.countDistinct("asset_id").alias("bad"))
    total = assets.where(F.col("first_seen_at") <= end).agg(F.countDistinct("asset_id").alias("total"))
    survivors = winners.join(F.broadcast(total)).select(F.lit("universe_includes_non_performers").alias("check_name"), ((F.col("total") > 0) & (F.col("bad") < 0.5 * F.col("total"))).alias("passed"), "bad")
    some = events.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("observation_lag_recorded").alias("check_name"), (F.col("n") > 0).alias("passed"), F.lit(0).cast("long").alias("bad"))
    return early_outcomes.unionByName(early_events).unionByName(survivors).unionByName(some)


@dataclass(frozen=True)
class Backtest:
    filled: DataFrame
    trades: DataFrame
    summary: DataFrame
    audit: DataFrame


def run(entries: DataFrame, candles: DataFrame, events: DataFrame, outcomes: DataFrame, assets: DataFrame, end: Column, config: BacktestConfig = BacktestConfig(), keep=keep) -> Backtest:
    """A backtest with its audit: results are not to be believed where a check of the audit fails."""
    filled = keep(fills(entries, candles, config))
    trades = keep(returns(filled, candles, config))
    return Backtest(filled, trades, summary(filled, trades), leakage_audit(events, outcomes, assets, end))


def paper_positions(orders: DataFrame, candles: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Paper positions of orders (entry_id, asset_id, signal_at), newest first."""
    return fills(orders, candles, config).orderBy(F.desc("signal_at"), "entry_id")
