"""All signal families at every tick of a clock, in one plan.

Every event has a first tick that sees it, and what a moment would compute over all events seen by then is kept as a
table of versions instead: edges, trade rates and operators' records are valid from the tick where they change to the next
such tick. Events are scanned as often as for a single moment, however many ticks there are; rows grow with the ticks
at which something is recent or changes. The rank of an action's size among all sizes that its tick has seen is
summed over blocks of ticks whose lengths are powers of two, so each size is counted in log(ticks) blocks, not once per tick.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions.tables import keep
from tracklight.functions.temporal import asof_join, previous_action, range_join
from tracklight.operators import graph as gr
from tracklight.operators import metrics as wm
from tracklight.operators import signals as sg
from tracklight.schema import DAY, GraphConfig, SignalConfig


@dataclass(frozen=True)
class Clock:
    """Moments ``start``, ``start`` + ``step``, ... up to ``end``, all in microseconds; ticks are numbered from 0."""

    start: int
    end: int
    step: int

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def first_to_see(self, us: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil((us - self.start) / self.step)).cast("long")

    def last_within(self, us: Column) -> Column:
        """The last tick that is not after ``us``."""
        return F.least(F.lit(self.last), F.floor((us - self.start) / self.step)).cast("long")

    def at(self, tick: Column) -> Column:
        return F.timestamp_micros((self.start + tick * self.step).cast("long"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.last + 1).select(self.at(F.col("id")).alias("as_of"))


def at_ticks(rows: DataFrame, clock: Clock, first: Column, last: Column) -> DataFrame:
    """``rows`` once for every tick (columns tick, as_of) from ``first`` to ``last``."""
    spread = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("tick", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return spread.withColumn("as_of", clock.at(F.col("tick")))


def recent(rows: DataFrame, clock: Clock, days: float) -> DataFrame:
    """Events once for every tick that is at most so many days later."""
    us = F.unix_micros("observed_at")
    return at_ticks(rows, clock, clock.first_to_see(us), clock.last_within(us + int(days * DAY)))


def size_shares(own: DataFrame, asked: DataFrame, clock: Clock) -> DataFrame:
    """(event_id, tick, size_share) of the asked (event_id, actor, tick, usd_value): the share of the actor's sizes seen by the tick that are not above.

    The ticks up to m are one block per bit of m + 1; in every block an action meets the sizes that were new there.
    """
    levels = F.sequence(F.lit(0), F.lit(int(clock.last + 1).bit_length()))
    sizes = own.where("usd_value IS NOT NULL").select("actor", "usd_value", clock.first_to_see(F.unix_micros("observed_at")).alias("k")).where(F.col("k") <= clock.last)
    sizes = sizes.select("actor", "usd_value", "k", F.explode(levels).alias("level")).select("actor", "level", F.expr("shiftright(k, level)").alias("block"), "usd_value")
    bits = asked.where("usd_value IS NOT NULL").select("event_id", "actor", "tick", "usd_value", F.explode(levels).alias("level")).where("(shiftright(tick + 1, level) & 1) = 1")
    bits = bits.select("actor", "level", (F.expr("shiftright(tick + 1, level)") - 1).alias("block"), "usd_value", "event_id", "tick")
    block = W.partitionBy("actor", "level", "block")
    size = F.when(F.col("event_id").isNull(), 1)
    both = sizes.unionByName(bits, allowMissingColumns=True)
    both = both.withColumns({"_below": F.count(size).over(block.orderBy("usd_value").rangeBetween(W.unboundedPreceding, 0)), "_all": F.count(size).over(block)})
    found = both.where("event_id IS NOT NULL").groupBy("event_id", "tick").agg(F.sum("_below").alias("_below"), F.sum("_all").alias("_all"))
    return found.select("event_id", "tick", (F.col("_below") / F.col("_all")).alias("size_share"))


def running(changes: DataFrame, by: list[str], sums: list[str], lows: tuple = (), highs: tuple = ()) -> DataFrame:
    """Running sums, minima and maxima of the changes (by, tick, ...) of every key, a row for each tick with a change."""
    per = changes.groupBy(*by, "tick").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
    over = W.partitionBy(*by).orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    kinds = {c: F.sum for c in sums} | {c: F.min for c in lows} | {c: F.max for c in highs}
    return per.select(*by, "tick", *[kind(c).over(over).alias(c) for c, kind in kinds.items()])


def actions(own: DataFrame, tracked: DataFrame, clock: Clock, config: SignalConfig) -> DataFrame:
    rows = previous_action(own.join(sg.known_of(tracked), "actor"))
    seen = recent(rows, clock, config.lookback_days)
    shares = size_shares(rows, seen.select("event_id", "actor", "tick", "usd_value"), clock)
    us = F.unix_micros("observed_at")
    rates = running(own.select("actor", clock.first_to_see(us).alias("tick"), F.lit(1).alias("n"), us.alias("low"), us.alias("high")), ["actor"], ["n"], ("low",), ("high",))
    months = fn.months_between(F.timestamp_micros("low"), F.timestamp_micros("high"))
    rates = rates.select("actor", "tick", (F.col("n") / months).alias("trades_per_month"))
    rated = asof_join(seen.select("actor", "tick").distinct(), rates, "tick", ["actor"], ["trades_per_month"])
    return sg.action_signals(seen.join(shares, ["event_id", "tick"], "left").join(rated, ["actor", "tick"], "left"), F.col("as_of"), config)


def edge_versions(events: DataFrame, wallets: DataFrame, clock: Clock, config: GraphConfig = GraphConfig()) -> DataFrame:
    """The edges of ``graph.edges`` with first_tick and last_tick, valid_from and valid_to: each pair as often as it changes.

    An asset counts for a pair from the tick that sees the later of both acquisitions; a version gathers a pair's assets
    up to its tick, so rows are the pair's assets times its changes, at most its ticks.
    """
    pairs = gr.pairs_of(events, wallets, F.timestamp_micros(F.lit(clock.start + clock.last * clock.step)), config)
    pairs = pairs.withColumn("tick", clock.first_to_see(F.col("_u")))
    changes = pairs.select("source", "target", F.col("tick").alias("first_tick")).distinct()
    following = F.lead("first_tick").over(W.partitionBy("source", "target").orderBy("first_tick"))
    changes = changes.withColumn("last_tick", F.coalesce(following - 1, F.lit(clock.last)))
    seen = changes.join(pairs, ["source", "target"]).where("tick <= first_tick")
    found = seen.groupBy("source", "target", "first_tick", "last_tick").agg(
        F.count(F.lit(1)).alias("observations"), F.median((F.col("_u") - F.col("_s")) / 1e6).alias("median_lag_seconds"), F.avg((F.col("_u") > F.col("_s")).cast("double")).alias("ordering_consistency")
    )
    return gr.typed(found, config).withColumns({"valid_from": clock.at(F.col("first_tick")), "valid_to": clock.at(F.col("last_tick") + 1)})


def sequences(events: DataFrame, versions: DataFrame, clock: Clock, config: SignalConfig) -> DataFrame:
    """The first follower of a leader's action does not depend on the tick: it is seen from its own tick on."""
    end, span = clock.start + clock.last * clock.step, int(config.sequence_days * DAY)
    acquired = events.where(fn.acquired_any(F.col("side")) & F.unix_micros("observed_at").between(clock.start - span, end)).select("event_id", "actor", F.coalesce("asset_id", F.lit("")).alias("_asset"), "asset_id", "observed_at")
    led = F.unix_micros("observed_at")
    leader = acquired.select(F.col("event_id").alias("leader_event"), F.col("actor").alias("source"), "_asset", "asset_id", F.col("observed_at").alias("led_at"), clock.first_to_see(led).alias("_from"), clock.last_within(led + span).alias("_until"))
    leads = versions.where("edge_type = 'leads' AND median_lag_seconds > 0")
    spans = leads.join(leader, "source").where("_from <= last_tick AND first_tick <= _until")
    spans = spans.withColumns({"_start": F.unix_micros("led_at") + 1, "_end": F.unix_micros("led_at") + F.floor(2e6 * F.col("median_lag_seconds")) + 1})
    follower = acquired.select(F.col("event_id").alias("follower_event"), F.col("actor").alias("target"), "_asset", F.col("observed_at").alias("followed_at"), F.unix_micros("observed_at").alias("_at"))
    by = ["source", "target", "leader_event", "asset_id", "led_at", "median_lag_seconds", "ordering_consistency", "confidence", "observations", "first_tick", "last_tick", "_from", "_until"]
    first = range_join(follower, spans, ["target", "_asset"], "_at", "_start", "_end", bucket=DAY).groupBy(*by).agg(F.min(F.struct("followed_at", "follower_event")).alias("f"))
    shown = at_ticks(first, clock, F.greatest("first_tick", "_from", clock.first_to_see(F.unix_micros("f.followed_at"))), F.least("last_tick", "_until"))
    return sg.sequence_signals(shown, F.col("as_of"))


def operators(own: DataFrame, outcomes: DataFrame, clock: Clock, config: SignalConfig) -> DataFrame:
    """Purchases of known operators, with the record that each tick knew; ``own`` has the operators' events."""
    rows = recent(own.where(fn.bought(F.col("side"))), clock, config.lookback_days)
    asked = keep(rows.select("actor", "tick").distinct())
    down = outcomes.where("outcome_class = 'rug_or_collapse'").groupBy("asset_id").agg(F.min("first_observed_at").alias("down_at"))
    touched = own.where("asset_id IS NOT NULL").groupBy("actor", "asset_id").agg(F.min("observed_at").alias("touched_at")).join(down, "asset_id", "left")
    fell = F.col("down_at").isNotNull()
    marks = F.array(
        F.struct(clock.first_to_see(F.unix_micros("touched_at")).alias("tick"), F.lit(1).alias("episodes"), F.lit(0).alias("collapsed")),
        F.struct(clock.first_to_see(F.unix_micros(F.greatest("touched_at", "down_at"))).alias("tick"), F.lit(0).alias("episodes"), fell.cast("int").alias("collapsed")),
    )
    record = running(touched.select("actor", F.explode(marks).alias("m")).select("actor", "m.*"), ["actor"], ["episodes", "collapsed"])
    known = asof_join(asked, record, "tick", ["actor"], ["episodes", "collapsed"]).where("episodes IS NOT NULL")
    held = asked.join(wm.holds(own).select("actor", clock.first_to_see(F.unix_micros("closed_at")).alias("_k"), "hours"), "actor").where("_k <= tick")
    medians = held.groupBy("actor", "tick").agg(F.median("hours").alias("_m"))
    full = known.join(medians, ["actor", "tick"], "left").select("actor", "tick", "episodes", "collapsed", F.coalesce("_m", F.lit(0.0)).alias("median_hours_to_distribution"))
    return sg.operator_signals(rows.join(full, ["actor", "tick"]), F.col("as_of"))


def candidates_surfaced(candidates: DataFrame, clock: Clock) -> DataFrame:
    us = F.unix_micros("surfaced_at")
    return sg.candidate_signals(at_ticks(candidates.where("status <> 'rejected'"), clock, clock.first_to_see(us), clock.last_within(us + clock.step)), F.col("as_of"))


def all_families(events: DataFrame, candidates: DataFrame, outcomes: DataFrame, clock: Clock, graph: GraphConfig = GraphConfig(), config: SignalConfig = SignalConfig()) -> DataFrame:
    """The signals of every family at every tick, with a set of candidates that stays: what ``signals.run_all`` gives at
    each moment, its edges being those of the moment and its candidates those surfaced since the tick before."""
    spark = events.sparkSession
    tracked = candidates.where("status IN ('tracked', 'shadow')")
    end = F.timestamp_micros(F.lit(clock.start + clock.last * clock.step))
    own = keep(wm.visible(events, end).join(candidates.select(F.col("wallet").alias("actor")).distinct(), "actor", "left_semi"))
    of_operators = own.join(candidates.where("archetype = 'pump_operator'").select(F.col("wallet").alias("actor")).distinct(), "actor", "left_semi")
    versions = keep(edge_versions(events, candidates.select(F.col("wallet").alias("actor")), clock, graph))
    ticks = clock.table(spark)
    return sg.union(
        actions(own, tracked, clock, config), sg.silent_accumulation(events, ticks, config), sg.convergence(own, tracked, versions, F.col("as_of"), config, ticks),
        sequences(events, versions, clock, config), operators(of_operators, outcomes, clock, config), candidates_surfaced(candidates, clock),
    )


def replay(events: DataFrame, candidates: DataFrame, outcomes: DataFrame, clock: Clock, graph: GraphConfig = GraphConfig(), config: SignalConfig = SignalConfig()) -> DataFrame:
    """Of the signals of a whole clock, the first of every dedupe key."""
    return sg.first_per_key(all_families(events, candidates, outcomes, clock, graph, config))
