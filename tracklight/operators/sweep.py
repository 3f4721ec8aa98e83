"""Whole jobs: the two-pass sweep over a universe, the nightly run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions.tables import keep
from tracklight.operators import discovery as ds
from tracklight.operators import graph as gr
from tracklight.operators import nightly as nl
from tracklight.operators import outcomes as oc
from tracklight.operators import policy, sinks
from tracklight.operators import signals as sg
from tracklight.schema import DAY, AlertConfig, DiscoveryConfig, GraphConfig, OutcomeConfig, SignalConfig, WalletConfig

Keep = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SweepResult:
    outcomes: DataFrame
    suspects: DataFrame
    scores: DataFrame
    report: DataFrame


def parse_coverage(events: DataFrame) -> DataFrame:
    """One row: share of events that could be parsed; 0 without events."""
    n = F.count(F.lit(1))
    return events.agg(F.when(n > 0, 1 - F.count_if(F.col("event_type") == "unknown_interaction") / n).otherwise(0.0).alias("parse_coverage"))


def two_pass(
    events: DataFrame, candles: DataFrame, assets: DataFrame, as_of: Column, window_days: int = 30, peak_volume: float = 50_000.0, most_suspects: int | None = None,
    detect: OutcomeConfig = OutcomeConfig(), discover: DiscoveryConfig = DiscoveryConfig(), wallets: WalletConfig = WalletConfig(), keep: Keep = keep,
) -> SweepResult:
    """Outcomes of the tradable universe; who bought before them; those actors scored over their full history.

    Assets that died count in the universe. The report has one row (key, value) per counter, those of the scores
    among them. ``most_suspects`` bounds how many actors are scored, by name, as a paid source of histories would.
    ``keep`` holds the tables that several steps read.
    """
    traded = sinks.tradable(candles, peak_volume)
    found = keep(oc.detect_all(candles.join(traded.select("asset_id"), "asset_id", "left_semi"), detect))
    actors, counts = sinks.suspects(events, found, window_days, most_suspects)
    actors = keep(actors)
    history = sinks.full_history(events, actors)
    scores = keep(ds.sweep(history, found, assets, as_of, config=discover, wallets=wallets, keep=keep))
    row = lambda key, df, value: df.select(F.lit(key).alias("key"), value.cast("double").alias("value"))
    report = [
        row("assets_priced", candles.agg(F.countDistinct("asset_id").alias("n")), F.col("n")), row("assets_tradable", traded.agg(F.count(F.lit(1)).alias("n")), F.col("n")),
        row("assets_dead", traded.agg(F.count_if("dead").alias("n")), F.col("n")), row("suspects_found", counts, F.col("found")), row("suspects_taken", counts, F.col("taken")),
        row("parse_coverage", parse_coverage(events), F.col("parse_coverage")), row("scored", scores.agg(F.count(F.lit(1)).alias("n")), F.col("n")), row("passed", scores.agg(F.count_if("passed").alias("n")), F.col("n")), found.groupBy(F.concat(F.lit("outcomes_"), "outcome_class").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")),
    ]
    return SweepResult(found, actors, scores, reduce(DataFrame.unionByName, report))


def provenance(appearing: DataFrame) -> DataFrame:
    """(actor, provenance): the appearances of an actor as JSON, by time."""
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return ds.provenance(appearing).select("actor", F.to_json("discovery_provenance", form).alias("provenance"))


@dataclass(frozen=True)
class Night:
    outcomes: DataFrame
    candidates: DataFrame
    signals: DataFrame
    decisions: DataFrame
    graded: DataFrame
    proposals: DataFrame
    digest: DataFrame


def nightly(
    events: DataFrame, candles: DataFrame, assets: DataFrame, known_outcomes: DataFrame, candidates: DataFrame, stored_signals: DataFrame, as_of: Column,
    detect: OutcomeConfig = OutcomeConfig(), discover: DiscoveryConfig = DiscoveryConfig(), wallets: WalletConfig = WalletConfig(), alert: AlertConfig = AlertConfig(), signal: SignalConfig = SignalConfig(),
    graph: GraphConfig = GraphConfig(), keep: Keep = keep, listed: DataFrame | None = None,
) -> Night:
    """Detect, grade, sweep, persist, advance, signal (all families), dispatch, propose. Each table of the result can be written on.

    ``stored_signals`` has signal_id, family, asset_id, wallet, triggered_at, significance, grade and delivered;
    ``listed`` are outcomes of a listing feed. ``keep`` holds the tables that several steps read. The outcomes of the
    result are the new ones.
    """
    found = oc.detect_all(candles, detect)
    new = keep(oc.insert_new(known_outcomes, found if listed is None else found.unionByName(listed.select(*found.columns))))
    outcomes = keep(known_outcomes.unionByName(new))
    graded = keep(nl.grade(stored_signals, outcomes, as_of))
    scores, appearing = ds.sweep_with_appearances(events, outcomes, assets, as_of, config=discover, wallets=wallets, keep=keep)
    scores = keep(scores)
    after = keep(ds.advance_lifecycle(ds.persist(candidates, scores, as_of, discover, appearing), as_of, discover))
    edges = keep(gr.edges(events, after.where("status IN ('tracked', 'shadow')").select(F.col("wallet").alias("actor")), as_of, graph))
    start = F.timestamp_micros((F.unix_micros(as_of) - int(signal.lookback_days * DAY)).cast("long"))
    found = keep(sg.run_all(events, after, edges, outcomes, as_of, start, signal))
    decided = keep(policy.dispatch(found, stored_signals, alert))
    mutes = nl.mute_proposals(nl.family_precision(graded), oc.base_rates(outcomes, assets, as_of, ("price_run",)))
    proposals = keep(nl.proposals(nl.threshold_proposal(graded, alert.threshold), mutes))
    counters = oc.detected_counts(new).select(F.lit("detected").alias("section"), F.col("outcome_class").alias("key"), F.col("written").cast("double").alias("value"))
    told = decided.groupBy(F.lit("decisions").alias("section"), F.col("decision").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    counts = ds.persist_counts(candidates, scores, discover)
    swept = counts.select(F.lit("discovery").alias("section"), F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("key", "value"))
    return Night(new, after, found, decided, graded, proposals, nl.digest(after, graded, proposals).unionByName(counters).unionByName(told).unionByName(swept))


def latest(rows: DataFrame, by: str, limit: int = 50) -> DataFrame:
    """The newest proposals, digests or positions."""
    return rows.orderBy(F.desc(by)).limit(limit)
