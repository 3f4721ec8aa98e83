"""Outcome detection from candles: runs, revivals, collapses, pumps; base rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.schema import DAY, HOUR, OutcomeConfig


def _days(n: float) -> int:
    return int(n * DAY)


OUTCOMES = (
    "outcome_id string, outcome_class string, asset_id string, t0 timestamp, first_observed_at timestamp, magnitude double, "
    "evidence map<string,string>, definition_version string, venue string"
)


def outcome_rows(rows: DataFrame, config: OutcomeConfig) -> DataFrame:
    """Rows with asset_id and a struct ``hit`` (outcome_class, t0, seen, magnitude, evidence) as an outcome table; null hits are left out."""
    t0 = F.col("hit.t0")
    return rows.where("hit IS NOT NULL").select(
        fn.outcome_id(F.col("hit.outcome_class"), F.col("asset_id"), t0).alias("outcome_id"),
        "hit.outcome_class",
        "asset_id",
        t0.alias("t0"),
        F.col("hit.seen").alias("first_observed_at"),
        F.bround(F.col("hit.magnitude"), 3).alias("magnitude"),
        F.col("hit.evidence").alias("evidence"),
        F.lit(config.definition_version).alias("definition_version"),
        F.lit(None).cast("string").alias("venue"),
    )


def _text(c: Column) -> Column:
    return c.cast("string")


def hits(candles: DataFrame, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    """(asset_id, run, revival, collapse): the first hit of each detector, null without one. One pass over each asset's candles.

    Run: a close that is a multiple of the least close of a liquid trailing window. Revival: an asset that was dormant
    some time before trades at a multiple of its dormant price soon after. Collapse: most of the running peak is lost.
    """
    by = W.partitionBy("asset_id").orderBy("_t")
    gap = _days(config.dormant_gap_days)
    base, so_far = by.rangeBetween(-_days(config.run_baseline_days), -1), by.rowsBetween(W.unboundedPreceding, 0)
    dormant, forward = by.rangeBetween(-gap - _days(config.dormant_days), -gap - 1), by.rangeBetween(0, _days(config.wake_days))
    rows = candles.withColumn("_t", F.unix_micros("start")).select(
        "asset_id", "start", "close",
        F.min("close").over(base).alias("base"), F.avg("volume").over(base).alias("volume"), F.count(F.lit(1)).over(base).alias("n"),
        F.count(F.lit(1)).over(dormant).alias("dormant_n"), F.avg("volume").over(dormant).alias("dormant_volume"), F.max("close").over(dormant).alias("dormant_base"), F.max("close").over(forward).alias("ahead"),
        F.max("close").over(so_far).alias("peak"),
    )
    c = F.col
    ran = (c("n") >= config.run_least_baseline) & (c("base") > 0) & (c("volume") >= config.run_least_volume) & (c("close") / c("base") >= config.run_multiple)
    woke = (c("dormant_n") >= config.dormant_least_baseline) & (c("dormant_volume") <= config.dormant_most_volume) & (c("dormant_base") > 0) & (c("ahead") / c("dormant_base") >= config.wake_multiple)
    drop = (c("peak") - c("close")) / c("peak")
    fell = (c("peak") > 0) & (drop >= config.drawdown)

    def first(condition, magnitude, evidence: dict) -> Column:
        shown = F.struct(*[v.cast("double").alias(k) for k, v in evidence.items()])
        return F.min(F.when(condition, F.struct(c("start").alias("t0"), magnitude.alias("magnitude"), shown.alias("shown"))))

    found = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("candles"),
        first(ran, c("close") / c("base"), {"baseline": c("base"), "peak": c("close")}).alias("run"),
        first(woke, c("ahead") / c("dormant_base"), {"dormant_avg_vol": c("dormant_volume")}).alias("revival"),
        first(fell, drop, {"peak": c("peak")}).alias("collapse"),
    )
    enough = {"run": config.run_least_candles, "revival": config.dormant_least_candles, "collapse": config.collapse_least_candles}
    return found.select("asset_id", *[F.when(c("candles") >= least, c(name)).alias(name) for name, least in enough.items()])


def _hit(name: str, outcome_class: str, config: OutcomeConfig, evidence: dict) -> Column:
    """The struct of ``outcome_rows`` for a detector's column of ``hits``; it is seen some hours after it happened."""
    hit = F.col(name)
    seen = F.timestamp_micros(F.unix_micros(hit["t0"]) + int(config.confirmation_hours * HOUR))
    shown = F.create_map(*[x for k, v in evidence.items() for x in (F.lit(k), v)])
    return F.when(hit.isNotNull(), F.struct(F.lit(outcome_class).alias("outcome_class"), hit["t0"].alias("t0"), seen.alias("seen"), hit["magnitude"].alias("magnitude"), shown.alias("evidence")))


def _run(config: OutcomeConfig) -> Column:
    return _hit("run", "price_run", config, {k: _text(F.col("run.shown")[k]) for k in ("baseline", "peak")})


def _revival(config: OutcomeConfig) -> Column:
    return _hit("revival", "revival", config, {"dormant_days": F.lit(f"{config.dormant_days:g}"), "dormant_avg_vol": _text(F.col("revival.shown.dormant_avg_vol"))})


def _collapse(config: OutcomeConfig) -> Column:
    return _hit("collapse", "rug_or_collapse", config, {"peak": _text(F.col("collapse.shown.peak"))})


def _pump(config: OutcomeConfig) -> Column:
    """A run that collapsed soon after; seen when the collapse is."""
    run, down = F.col("run.t0"), F.col("collapse.t0")
    gap = F.unix_micros(down) - F.unix_micros(run)
    seen = F.timestamp_micros(F.unix_micros(down) + int(config.confirmation_hours * HOUR))
    evidence = F.create_map(
        F.lit("run_outcome_id"), fn.outcome_id("price_run", F.col("asset_id"), run), F.lit("collapse_outcome_id"), fn.outcome_id("rug_or_collapse", F.col("asset_id"), down),
        F.lit("hours_to_collapse"), _text(F.round(gap / HOUR, 1)),
    )
    hit = F.struct(F.lit("pump_event").alias("outcome_class"), run.alias("t0"), seen.alias("seen"), F.col("run.magnitude").alias("magnitude"), evidence.alias("evidence"))
    return F.when((gap > 0) & (gap <= _days(config.pump_gap_days)), hit)


def _detected(candles: DataFrame, config: OutcomeConfig, *makers) -> DataFrame:
    found = hits(candles, config)
    return outcome_rows(found.select("asset_id", F.explode(F.array(*[make(config) for make in makers])).alias("hit")), config)


def price_runs(candles: DataFrame, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    return _detected(candles, config, _run)


def revivals(candles: DataFrame, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    return _detected(candles, config, _revival)


def collapses(candles: DataFrame, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    return _detected(candles, config, _collapse)


def pump_events(candles: DataFrame, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    return _detected(candles, config, _pump)


def detect_all(candles: DataFrame, config: OutcomeConfig = OutcomeConfig()) -> DataFrame:
    """The outcomes of all detectors, from one pass."""
    return _detected(candles, config, _run, _revival, _collapse, _pump)


def detected_counts(new: DataFrame) -> DataFrame:
    """(outcome_class, written) of the rows of ``insert_new``."""
    return new.groupBy("outcome_class").agg(F.count(F.lit(1)).alias("written"))


def insert_new(known: DataFrame, found: DataFrame) -> DataFrame:
    """Outcomes of ``found`` that ``known`` lacks: outcomes never change once stored."""
    return found.dropDuplicates(["outcome_id"]).join(known.select("outcome_id"), "outcome_id", "left_anti").select(*found.columns)


def observable(outcomes: DataFrame, as_of: Column, classes: Sequence[str]) -> DataFrame:
    return outcomes.where((F.col("first_observed_at") <= as_of) & F.col("outcome_class").isin(*classes))


def base_rates(outcomes: DataFrame, assets: DataFrame, as_of: Column, classes: Sequence[str]) -> DataFrame:
    """(outcome_class, hits, total, rate) of every class, also of those without hits.

    Hit assets need not be registered, so a rate may exceed 1.
    """
    spark = outcomes.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "outcome_class string")
    hits = outcomes.where(F.col("first_observed_at") <= as_of).groupBy("outcome_class").agg(F.countDistinct("asset_id").alias("hits"))
    total = assets.where(F.col("first_seen_at") <= as_of).agg(F.countDistinct("asset_id").alias("total"))
    joined = names.join(hits, "outcome_class", "left").join(F.broadcast(total))  # one row
    n = F.coalesce("hits", F.lit(0))
    return joined.select("outcome_class", n.alias("hits"), "total", F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0).alias("rate"))
