"""Sequences of stages that entities go through before outcomes, and playbooks made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.medians import medians
from tracklight.schema import DAY, PREDICTIVE, STAGES, PlaybookConfig


def staged_events(events: DataFrame, members: DataFrame, as_of: Column, config: PlaybookConfig = PlaybookConfig(), per_asset_median: bool = False) -> DataFrame:
    """Events of members (entity_id, wallet, is_primary) with their stage; the median size is the entity's."""
    rows = events.where(F.col("observed_at") <= as_of).join(members.select("entity_id", F.col("wallet").alias("actor"), "is_primary"), "actor")
    keys = ["entity_id", "asset_id"] if per_asset_median else ["entity_id"]
    rows = rows.join(medians(rows, keys, {"_median": F.col("usd_value")}), keys, "left").withColumn("_median", F.coalesce("_median", F.lit(0.0)))
    stage = fn.stage_of(F.col("event_type"), F.col("side"), F.col("filled"), F.col("usd_value"), F.col("_median"), config.probe_ratio)
    rows = rows.withColumn("stage", stage).where("stage IS NOT NULL AND asset_id IS NOT NULL")
    return rows.withColumn("stage", F.when((F.col("stage") == "accumulating") & ~F.col("is_primary"), "confirming").otherwise(F.col("stage")))


def sequences(staged: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """One row per entity and asset: stages in first-seen order, first moments of each, and how it ended."""
    firsts = staged.groupBy("entity_id", "asset_id", "stage").agg(F.min(F.struct("observed_at", "event_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    seqs = firsts.groupBy("entity_id", "asset_id").agg(F.array_sort(F.collect_list(F.struct("first", "stage"))).alias("_s"), F.sum("n").alias("observations"))
    known = outcomes.where((F.col("first_observed_at") <= as_of) & F.col("outcome_class").isin(*PREDICTIVE))
    ends = known.groupBy("asset_id").agg(F.min(F.struct("t0", "outcome_class")).alias("_end"))
    joined = seqs.join(ends, "asset_id", "left")
    stages = F.transform("_s", lambda x: x["stage"])
    return joined.select(
        "entity_id", "asset_id", stages.alias("stages"), F.transform("_s", lambda x: F.struct(x["stage"].alias("stage"), x["first"]["observed_at"].alias("at"))).alias("first_at"), "observations",
        F.col("_end.outcome_class").alias("outcome_class"), F.col("_end.t0").alias("outcome_t0"), F.col("_end").isNotNull().alias("completed"), (F.col("_end").isNull() & F.array_contains(stages, "aborted")).alias("aborted"),
    )


def playbooks(seqs: DataFrame, config: PlaybookConfig = PlaybookConfig()) -> DataFrame:
    """Per entity with enough completed sequences: stages of half of them at least, in order, and median lags in days."""
    totals = seqs.groupBy("entity_id").agg(F.count_if("completed").alias("supporting"), F.count_if(F.col("aborted")).alias("aborted_sequences")).where(F.col("supporting") >= config.min_sequences)
    each = seqs.where("completed").select("entity_id", "outcome_t0", F.explode("first_at").alias("f")).select("entity_id", "f.stage", fn.days_between(F.col("f.at"), F.col("outcome_t0")).alias("lag"))
    lags = medians(each, ["entity_id", "stage"], {"lag": F.col("lag")}).withColumn("lag", F.round("lag", 2))
    per_stage = each.groupBy("entity_id", "stage").agg(F.count(F.lit(1)).alias("n")).join(lags, ["entity_id", "stage"], "left")
    summed = per_stage.join(totals, "entity_id").groupBy("entity_id", "supporting", "aborted_sequences").agg(
        F.collect_set(F.when(F.col("n") >= F.col("supporting") * 0.5, F.col("stage"))).alias("_kept"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "lag")))).alias("median_stage_lags")
    )
    order = F.array(*map(F.lit, STAGES))
    return summed.select("entity_id", F.filter(order, lambda s: F.array_contains(F.col("_kept"), s)).alias("stages"), "supporting", "aborted_sequences", "median_stage_lags")


def current_stages(events: DataFrame, members: DataFrame, as_of: Column, config: PlaybookConfig = PlaybookConfig()) -> DataFrame:
    """The last stage of every entity and asset in the window, with its place in the order from 1, or 0."""
    recent = events.where(F.unix_micros("observed_at") >= F.unix_micros(as_of) - int(config.window_days * DAY))
    staged = staged_events(recent, members, as_of, config, per_asset_median=True)
    last = F.max_by(F.struct("stage", "observed_at"), F.struct("observed_at", "event_id"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("s.stage")), F.lit(0)).cast("int")
    found = staged.groupBy("entity_id", "asset_id").agg(last.alias("s"))
    return found.select("entity_id", "asset_id", F.col("s.stage").alias("stage"), place.alias("stage_index"), F.col("s.observed_at").alias("entered_at"), F.lit(0.6).alias("confidence"))


def stage_base_rates(books: DataFrame) -> DataFrame:
    return books.select("entity_id", F.col("supporting").alias("completed"), (F.col("supporting") + F.col("aborted_sequences")).alias("total"))
