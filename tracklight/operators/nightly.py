"""Grading of signals against later outcomes, and proposals that follow from the grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions.temporal import next_after
from tracklight.schema import DAY, MUTED_FAMILIES, PREDICTIVE

THRESHOLDS = (0.25, 0.35, 0.45, 0.55, 0.65)


def grade(signals: DataFrame, outcomes: DataFrame, as_of: Column, horizon_days: float = 21) -> DataFrame:
    """Pending signals get hit, miss, not_applicable or stay pending; other grades stay.

    A hit needs a predictive outcome on the asset after the signal; it has no horizon of its own. ``signals`` has
    signal_id, asset_id, triggered_at and grade; an outcome_id and lead_time_days that it has stay where there is one.
    """
    later = outcomes.where(F.col("outcome_class").isin(*PREDICTIVE) & (F.col("first_observed_at") <= as_of)).select("asset_id", "outcome_id", "outcome_class", "t0")
    pending = signals.where("grade = 'pending' AND asset_id IS NOT NULL").select("signal_id", "asset_id", "triggered_at")
    found = next_after(pending, later.withColumn("_t0", F.col("t0")), "triggered_at", "_t0", ["asset_id"], ["t0", "outcome_id", "outcome_class"])
    hits = found.where(F.col("t0").isNotNull()).groupBy("signal_id").agg(F.min(F.struct("t0", "outcome_id", "outcome_class")).alias("_hit"))
    rows = signals.join(hits, "signal_id", "left")
    old = F.unix_micros(as_of) - F.unix_micros("triggered_at") >= int(horizon_days * DAY)
    new = F.when(F.col("grade") != "pending", F.col("grade")).when(F.col("asset_id").isNull(), "not_applicable").when(F.col("_hit").isNotNull(), "hit").when(old, "miss").otherwise("pending")
    lead = F.round((F.unix_micros("_hit.t0") - F.unix_micros("triggered_at")) / DAY, 2)
    made = {"outcome_id": F.col("_hit.outcome_id"), "lead_time_days": lead}
    shown = [F.coalesce(c, made[n]).alias(n) if n in signals.columns else made[n].alias(n) for n, c in ((n, F.col(n)) for n in made)]
    return rows.select(*[new.alias("grade") if c == "grade" else F.col(c) for c in signals.columns if c not in made], *shown)


def family_precision(graded: DataFrame) -> DataFrame:
    judged = graded.where("grade IN ('hit', 'miss')")
    hits = F.count_if(F.col("grade") == "hit")
    return judged.groupBy("family").agg(F.count(F.lit(1)).alias("graded"), hits.alias("hits"), (hits / F.count(F.lit(1))).alias("precision"))


def threshold_sweep(graded: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, survivors, precision): one pass, each signal counted for the thresholds that it reaches."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = graded.where("grade IN ('hit', 'miss')").select("grade", F.explode(F.filter(levels, lambda t: t <= F.col("significance"))).alias("threshold"))
    found = reached.groupBy("threshold").agg(F.count(F.lit(1)).alias("survivors"), (F.count_if(F.col("grade") == "hit") / F.count(F.lit(1))).alias("precision"))
    every = graded.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return every.join(found, "threshold", "left").select("threshold", F.coalesce("survivors", F.lit(0)).alias("survivors"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def threshold_proposal(graded: DataFrame, current: float = 0.35, margin: float = 0.05, least: int = 10, least_graded: int = 20) -> DataFrame:
    """(current, proposed, graded): thresholds are tried in order, and each must beat the best so far by the margin."""
    tried = sorted({*THRESHOLDS, current})
    swept = threshold_sweep(graded, tried)
    rows = swept.agg(F.array_sort(F.collect_list(F.struct("threshold", "survivors", "precision"))).alias("r"))
    now = F.filter("r", lambda x: x["threshold"] == current)[0]["precision"]
    start = F.struct(F.lit(current).alias("best"), now.alias("precision"))

    def step(a, x):
        better = x["threshold"].isin(*THRESHOLDS) & (x["precision"] > a["precision"] + margin) & (x["survivors"] >= least)
        return F.when(better, F.struct(x["threshold"].alias("best"), x["precision"].alias("precision"))).otherwise(a)

    total = graded.where("grade IN ('hit', 'miss')").agg(F.count(F.lit(1)).alias("graded"))
    found = rows.select(F.aggregate("r", start, step)["best"].alias("proposed")).join(F.broadcast(total))  # one row each
    return found.select(F.lit(current).alias("current"), F.when(F.col("graded") >= least_graded, F.col("proposed")).otherwise(current).alias("proposed"), "graded")


def mute_proposals(precision: DataFrame, base_rate: DataFrame, least: int = 30, muted=MUTED_FAMILIES) -> DataFrame:
    """Families to mute (worse than picking assets at random) or to hear again (better than twice that)."""
    rate = base_rate.where("outcome_class = 'price_run'").select(F.col("rate").alias("base_rate"))
    rows = precision.where(F.col("graded") >= least).join(F.broadcast(rate))  # one row
    quiet = F.col("family").isin(*muted)
    kind = F.when(~quiet & (F.col("precision") < F.col("base_rate")), "mute_family").when(quiet & (F.col("precision") > 2 * F.col("base_rate")), "unmute_family")
    return rows.select("family", kind.alias("kind"), "graded", "precision", "base_rate").where("kind IS NOT NULL")


def proposals(thresholds: DataFrame, mutes: DataFrame) -> DataFrame:
    """(kind, target, current, proposed, sample_size, status): a threshold to change, and families to mute or to hear again."""
    changed = thresholds.where("proposed <> current").select(
        F.lit("threshold").alias("kind"), F.lit("min_significance").alias("target"), F.col("current").cast("string").alias("current"), F.col("proposed").cast("string").alias("proposed"), F.col("graded").alias("sample_size")
    )
    muting = F.col("kind") == "mute_family"
    families = mutes.select("kind", F.col("family").alias("target"), F.when(muting, "heard").otherwise("muted").alias("current"), F.when(muting, "muted").otherwise("heard").alias("proposed"), F.col("graded").alias("sample_size"))
    return changed.unionByName(families).withColumn("status", F.lit("pending"))


def apply_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending proposals (proposal_id, status, ...) change as decisions (proposal_id, decision, by, at) say; others never do."""
    latest = decisions.groupBy("proposal_id").agg(F.max_by(F.struct("decision", "by", "at"), "at").alias("_d"))
    rows = proposals.join(latest, "proposal_id", "left")
    status = F.when((F.col("status") == "pending") & F.col("_d").isNotNull(), F.col("_d.decision")).otherwise(F.col("status"))
    return rows.select(*[status.alias("status") if c == "status" else F.col(c) for c in proposals.columns])


def digest(candidates: DataFrame, graded: DataFrame, proposals: DataFrame) -> DataFrame:
    """The night's facts as (section, key, value) rows."""
    n = F.count(F.lit(1)).cast("double")
    of_candidates = candidates.where("status IN ('tracked', 'shadow')").groupBy(F.lit("candidates").alias("section"), F.col("status").alias("key")).agg(n.alias("value"))
    of_grades = graded.groupBy(F.lit("grades").alias("section"), F.col("grade").alias("key")).agg(n.alias("value"))
    of_families = family_precision(graded).select(F.lit("precision").alias("section"), F.col("family").alias("key"), F.col("precision").alias("value"))
    of_proposals = proposals.where("status = 'pending'").groupBy(F.lit("proposals").alias("section"), F.col("kind").alias("key")).agg(n.alias("value"))
    return of_candidates.unionByName(of_grades).unionByName(of_families).unionByName(of_proposals)
