"""Reverse discovery: from outcomes back to the actors that were early, scored against base rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.tables import keep
from tracklight.functions.temporal import range_join
from tracklight.operators import metrics as wm
from tracklight.operators import outcomes as oc
from tracklight.schema import DAY, PREDICTIVE, DiscoveryConfig, WalletConfig

EXCLUDED = ("bot", "high_frequency")
EXACT = "decimal(28,26)"  # of a rate: actors with the same mix of classes get the same mean, in whatever order rows are added, and so the same rank


def appearances(events: DataFrame, outcomes: DataFrame, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """First acquisition of every actor in the lookback before each outcome: an interval join, bucketed by time."""
    return appearances_of(wm.acquisitions(events), outcomes, config)


def appearances_of(acquired: DataFrame, outcomes: DataFrame, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    widest = max(config.lookback_days) * DAY
    spans = outcomes.select("outcome_id", "outcome_class", "asset_id", "t0", (F.unix_micros("t0") - widest).alias("_start"), F.unix_micros("t0").alias("_end"))
    points = acquired.where("acquired_any").select("event_id", "actor", "asset_id", "observed_at", "usd_value", F.unix_micros("observed_at").alias("_at"))
    joined = range_join(points, spans, ["asset_id"], "_at", "_start", "_end", bucket=30 * DAY)
    entry = F.min(F.struct("observed_at", "event_id", "usd_value")).alias("e")
    first = joined.groupBy("outcome_id", "outcome_class", "asset_id", "t0", "actor").agg(entry)
    lead = fn.days_between(F.col("e.observed_at"), F.col("t0"))
    return first.select(
        "actor", "outcome_id", "outcome_class", "asset_id", "t0", F.col("e.observed_at").alias("entered_at"), F.col("e.usd_value").alias("usd_value"),
        lead.alias("lead_time_days"), fn.lookback_bucket(lead, config.lookback_days).alias("window"),
    )


def independent_events(appearing: DataFrame, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """(actor, independent_events): clusters of first appearances per asset; a new one starts when t0 is more than
    the independence window after the start of the last. The fold runs over one actor's distinct assets."""
    per_asset = appearing.groupBy("actor", "asset_id").agg(F.min(F.unix_micros("t0")).alias("t"))
    window = int(config.independence_days * DAY)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("anchor"))

    def step(a, t):
        fresh = a["anchor"].isNull() | (t - a["anchor"] > window)
        return F.struct(F.when(fresh, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fresh, t).otherwise(a["anchor"]).alias("anchor"))

    folded = F.aggregate(F.sort_array("ts"), start, step, lambda a: a["n"])
    return per_asset.groupBy("actor").agg(F.collect_list("t").alias("ts")).select("actor", folded.alias("independent_events"))


def added_rates(based: DataFrame) -> DataFrame:
    """(actor, added_rate): the mean of ``rate`` as doubles give it that are added one by one, from the least up.

    Guards compare it, as a sum of doubles decides what becomes of an actor that is right at a bound; that must not hang
    on the order of rows. Rows meet as counts, one per actor and rate.
    """
    counts = based.groupBy("actor", F.coalesce("rate", F.lit(0.0)).alias("rate")).agg(F.count(F.lit(1)).alias("n"))
    by_rate = counts.groupBy("actor").agg(F.sort_array(F.collect_list(F.struct("rate", "n"))).alias("rates"), F.sum("n").alias("rows"))  # an element per class at most
    add = lambda total, r: F.aggregate(F.sequence(F.lit(1).cast("long"), r["n"]), total, lambda t, _: t + r["rate"])
    return by_rate.select("actor", (F.aggregate("rates", F.lit(0.0), add) / F.col("rows")).alias("added_rate"))


def rejection(config: DiscoveryConfig = DiscoveryConfig(), edge: str = "edge_ratio", shrunk: str = "shrunk_hit_rate") -> Column:
    """The first guard that a scored actor fails; null if it passes all. ``edge`` and ``shrunk`` name the columns that are compared."""
    c = F.col
    return (
        F.when(c("archetype").isin(*EXCLUDED), F.concat_ws(":", F.lit("excluded_archetype"), c("archetype"), F.coalesce(c("excluded_reason"), F.lit("None"))))
        .when(c("hits") < config.min_events, F.format_string(f"too_few_events:%d<{config.min_events}", c("hits")))
        .when(c("independent_events") < config.min_independent, F.format_string(f"insufficient_independence:%d<{config.min_independent}", c("independent_events")))
        .when(c(edge) < config.min_edge, F.format_string(f"edge_vs_base_rate:%.2f<{config.min_edge}", c(edge)))
        .when(c(shrunk) < config.min_shrunk, F.format_string(f"shrunk_hit_rate:%.3f<{config.min_shrunk}", c(shrunk)))
    )


def score(appearing: DataFrame, metrics: DataFrame, rates: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), wallets: WalletConfig = WalletConfig()) -> DataFrame:
    """One scored row per appearing actor. ``metrics`` has distinct_tokens, archetype and excluded_reason per actor."""
    based = appearing.join(F.broadcast(rates.select("outcome_class", "rate")), "outcome_class", "left")  # one row per class
    hits = based.groupBy("actor").agg(
        F.countDistinct("asset_id").alias("hits"), F.count(F.lit(1)).alias("appearances"), F.median("lead_time_days").alias("median_lead_days"),
        F.avg(F.coalesce("rate", F.lit(0.0)).cast(EXACT)).cast("double").alias("base_rate"),
    )
    joined = hits.join(added_rates(based), "actor").join(independent_events(appearing, config), "actor").join(metrics.select("actor", "distinct_tokens", "archetype", "excluded_reason"), "actor", "left")
    touched = F.coalesce("distinct_tokens", F.lit(0))
    trials = F.greatest(touched, F.col("hits"))
    shrunk, guarded = (fn.shrink(F.col("hits"), trials, F.col(base), wallets.prior) for base in ("base_rate", "added_rate"))
    scored = joined.select(
        "actor", "hits", "appearances", touched.alias("touched"), F.when(touched > 0, F.col("hits") / touched).otherwise(0.0).alias("hit_rate"), "independent_events", "median_lead_days",
        "base_rate", shrunk.alias("shrunk_hit_rate"), fn.wilson(F.col("hits"), trials).alias("interval"), "archetype", "excluded_reason", "added_rate", guarded.alias("_shrunk"),
    )
    edge = lambda rate, base: F.when(F.col(base) > 0, F.col(rate) / F.col(base)).otherwise(0.0)
    scored = scored.withColumns({"edge_ratio": edge("shrunk_hit_rate", "base_rate"), "_edge": edge("_shrunk", "added_rate")})
    scored = scored.withColumn("rejection_reason", rejection(config, "_edge", "_shrunk")).drop("_edge", "_shrunk", "added_rate")
    return scored.withColumn("passed", F.col("rejection_reason").isNull())


def sweep(
    events: DataFrame, outcomes: DataFrame, assets: DataFrame, as_of: Column, since: Column | None = None, config: DiscoveryConfig = DiscoveryConfig(), wallets: WalletConfig = WalletConfig(), keep=keep
) -> DataFrame:
    """Scores of all actors that were early to an observable outcome; passed ones with the largest edge first."""
    return sweep_with_appearances(events, outcomes, assets, as_of, since, config, wallets, keep)[0]


def sweep_with_appearances(
    events: DataFrame, outcomes: DataFrame, assets: DataFrame, as_of: Column, since: Column | None = None, config: DiscoveryConfig = DiscoveryConfig(), wallets: WalletConfig = WalletConfig(), keep=keep
) -> tuple[DataFrame, DataFrame]:
    """The scores of ``sweep``, and the appearances that they rest on.

    ``keep`` writes what several steps read: the acquisitions, the appearances, the rates.
    """
    known = oc.observable(outcomes, as_of, PREDICTIVE)
    if since is not None:
        known = known.where(F.col("first_observed_at") >= since)
    acquired = keep(wm.acquisitions(events))
    found = keep(appearances_of(acquired, known, config))
    rates = keep(oc.base_rates(outcomes, assets, as_of, PREDICTIVE))
    metrics = wm.wallet_metrics(events, outcomes, assets, as_of, config=wallets, acquired=acquired, keep=keep)
    return score(found, metrics, rates, config, wallets).orderBy(F.desc("passed"), F.desc("edge_ratio"), F.desc("independent_events"), "actor"), found


def near_misses(scores: DataFrame, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    return scores.where("NOT passed").orderBy(F.desc("hits"), F.desc("edge_ratio"), "actor").limit(config.near_misses)


PROVENANCE = "array<struct<t0:timestamp,outcome_id:string,asset_id:string,outcome_class:string,entered_at:timestamp,lead_time_days:double,window:string>>"
CANDIDATES = (
    "wallet string, network string, status string, surfaced_at timestamp, shadow_started_at timestamp, promoted_at timestamp, retired_at timestamp, archetype string, hit_rate double, shrunk_hit_rate double, "
    f"base_rate double, edge_vs_base double, sample_size int, independent_events int, rejection_reason string, discovery_provenance {PROVENANCE}"
)


def provenance(appearing: DataFrame) -> DataFrame:
    """(actor, discovery_provenance): the appearances of an actor, by time."""
    item = F.struct("t0", "outcome_id", "asset_id", "outcome_class", "entered_at", F.round("lead_time_days", 2).alias("lead_time_days"), "window")
    return appearing.groupBy("actor").agg(F.array_sort(F.collect_list(item)).alias("discovery_provenance"))


def persist(known: DataFrame, scores: DataFrame, as_of: Column, config: DiscoveryConfig = DiscoveryConfig(), appearing: DataFrame | None = None) -> DataFrame:
    """The candidate table after a sweep: passed actors and the nearest misses come in, and all that are known already
    get their new figures; a status is set once.

    With ``appearing``, the appearances of the merged actors are their provenance, and their network that of the
    first asset; without, what is stored of both stays.
    """
    again = known.select(F.col("wallet").alias("actor"), F.lit(True).alias("_known"))
    near = near_misses(scores, config).select("actor", F.lit(True).alias("_near"))
    kept = scores.join(near, "actor", "left").join(again, "actor", "left").where("passed OR _near OR _known").drop("_near", "_known")
    if appearing is None:
        kept = kept.withColumn("discovery_provenance", F.lit(None).cast(PROVENANCE))
    else:
        kept = kept.join(provenance(appearing.join(kept.select("actor"), "actor", "left_semi")), "actor", "left")
    figures = (("hit_rate", "hit_rate"), ("shrunk_hit_rate", "shrunk_hit_rate"), ("base_rate", "base_rate"), ("edge_ratio", "edge_vs_base"))
    new = kept.select(
        F.col("actor").alias("wallet"), F.when(F.col("passed"), "surfaced").otherwise("rejected").alias("new_status"), F.coalesce("archetype", F.lit("unclassified")).alias("new_archetype"),
        *[F.bround(F.col(c), 4).alias(f"new_{n}") for c, n in figures],
        F.greatest("touched", "hits").cast("int").alias("new_sample_size"), F.col("independent_events").cast("int").alias("new_independent_events"), F.col("rejection_reason").alias("new_rejection_reason"),
        F.split_part(F.get("discovery_provenance", F.lit(0))["asset_id"], F.lit(":"), F.lit(1)).alias("new_network"), F.col("discovery_provenance").alias("new_discovery_provenance"),
    )
    both = known.join(new, "wallet", "full_outer")
    fresh = F.col("new_status").isNotNull()
    pick = lambda n: F.when(fresh, F.col(f"new_{n}")).otherwise(F.col(n)).alias(n)
    return both.select(
        "wallet", F.coalesce("network", "new_network").alias("network"), F.coalesce("status", "new_status").alias("status"), F.coalesce("surfaced_at", F.when(fresh, as_of)).alias("surfaced_at"),
        "shadow_started_at", "promoted_at", "retired_at",
        *[pick(n) for n in ("archetype", "hit_rate", "shrunk_hit_rate", "base_rate", "edge_vs_base", "sample_size", "independent_events", "rejection_reason")],
        F.coalesce("new_discovery_provenance", "discovery_provenance").alias("discovery_provenance"),
    )


def persist_counts(known: DataFrame, scores: DataFrame, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """One row: how many scored actors ``persist`` adds as passed (surfaced), updates, rejects, and rejects but records."""
    again = known.select(F.col("wallet").alias("actor"), F.lit(True).alias("_known"))
    near = near_misses(scores, config).select("actor", F.lit(True).alias("_near"))
    rows = scores.join(near, "actor", "left").join(again, "actor", "left")
    new = F.col("_known").isNull()
    return rows.agg(
        F.count_if(new & F.col("passed")).alias("surfaced"), F.count_if(~new).alias("updated"), F.count_if(new & ~F.col("passed")).alias("rejected"),
        F.count_if(new & ~F.col("passed") & F.col("_near").isNotNull()).alias("rejections_recorded"),
    )


def advance_lifecycle(candidates: DataFrame, now: Column, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """One step for every candidate: surfaced ones go to shadow; shadow ones are tracked or decay after their time."""
    ripe = (F.col("status") == "shadow") & (F.unix_micros(now) - F.unix_micros("shadow_started_at") >= int(config.shadow_days * DAY))
    good = F.col("edge_vs_base") >= config.min_edge
    status = F.when(F.col("status") == "surfaced", "shadow").when(ripe & good, "tracked").when(ripe, "decaying").otherwise(F.col("status"))
    after = candidates.withColumn("_status", status)
    return after.select(
        *[
            F.col("_status").alias("status") if c == "status"
            else F.when((F.col("status") == "surfaced"), now).otherwise(F.col(c)).alias(c) if c == "shadow_started_at"
            else F.when(F.col("_status").eqNullSafe("tracked") & (F.col("status") == "shadow"), now).otherwise(F.col(c)).alias(c) if c == "promoted_at"
            else F.col(c)
            for c in candidates.columns
        ],
        F.when(F.col("status") != F.col("_status"), F.concat_ws("->", "status", "_status")).alias("transition"),
    )


def control_actors(events: DataFrame, sample: int = 40, pool: int = 500) -> DataFrame:
    """Actors taken by their order alone: every so many-th of the first ``pool``."""
    actors = events.select("actor").distinct().orderBy("actor").limit(pool)
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))  # pool rows at most
    placed = actors.select("actor", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("actor")) - 1).alias("_i"), F.greatest(F.lit(1), F.floor(n / sample)).alias("_step"))
    return placed.where("_i % _step = 0").orderBy("actor").limit(sample).select("actor")


def control_scores(events: DataFrame, metrics: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), sample: int = 40, pool: int = 500) -> DataFrame:
    """The control's actors scored as if they had been early to nothing: by the same guards, none may pass."""
    rows = control_actors(events, sample, pool).join(metrics.select("actor", "distinct_tokens", "archetype", "excluded_reason"), "actor", "left")
    nothing = {"hits": F.lit(0).cast("long"), "independent_events": F.lit(0).cast("long"), "edge_ratio": F.lit(0.0), "shrunk_hit_rate": F.lit(0.0)}
    scored = rows.withColumns(nothing).withColumn("rejection_reason", rejection(config))
    return scored.withColumn("passed", F.col("rejection_reason").isNull())


def negative_control(events: DataFrame, metrics: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), sample: int = 40, pool: int = 500) -> DataFrame:
    """One row (name, surfaced, median_edge_ratio, note): how many of the control's actors pass. Anything but 0 is a fault of the guards."""
    found = control_scores(events, metrics, config, sample, pool).agg(F.count_if("passed").alias("surfaced"), F.coalesce(F.median("edge_ratio"), F.lit(0.0)).alias("median_edge_ratio"), F.count(F.lit(1)).alias("n"))
    return found.select(F.lit("random_wallet").alias("name"), "surfaced", "median_edge_ratio", F.format_string("%d wallets sampled with no outcome appearances attributed", "n").alias("note"))


def survival(frozen: DataFrame, present: DataFrame) -> DataFrame:
    """(kept, lost, gained, survival_rate) of the actors that passed at an earlier moment."""
    a, b = frozen.where("passed").select("actor"), present.where("passed").select("actor")
    marks = a.withColumn("was", F.lit(1)).join(b.withColumn("is", F.lit(1)), "actor", "full_outer")
    kept = F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull())
    lost = F.count_if(F.col("was").isNotNull() & F.col("is").isNull())
    return marks.agg(kept.alias("kept"), lost.alias("lost"), F.count_if(F.col("was").isNull()).alias("gained")).withColumn("survival_rate", F.when(F.col("kept") + F.col("lost") > 0, F.col("kept") / (F.col("kept") + F.col("lost"))))
