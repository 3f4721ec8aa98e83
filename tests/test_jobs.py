"""Whole jobs against plain Python over what their steps give."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracklight.operators import graph as gr
from tracklight.operators import policy, replay
from tracklight.operators import signals as sg
from tracklight.plans import all_queries, q_graph, q_jobs, q_outcomes, q_signals
from tracklight.schema import HOUR, MUTED_FAMILIES, AlertConfig
from tracklight.sources import adapters
from tracklight.streaming import events as stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
QUERIES = all_queries.queries()


def decide(signals, history, config):
    """The alert policy, one signal after another. Signals are (family, asset, wallet, us, significance, risks), history too with delivered."""
    day = lambda us: us // (24 * HOUR)
    key = lambda s: (s[0], s[1], s[2], day(s[3]))
    stored, told, out = [h[:4] for h in history], {}, []
    for h in history:
        if h[4]:
            told[day(h[3])] = told.get(day(h[3]), 0) + 1
    for s in signals[: config.max_per_run]:
        critical = s[0] == "pump_operator_activity"
        if key(s) in {key(x) for x in stored}:
            out.append("duplicate")
        elif s[4] < config.threshold and not critical:
            out.append("threshold")
        elif not critical and any(x[:3] == s[:3] and 0 <= s[3] - x[3] <= config.cooldown_hours * HOUR for x in stored):
            out.append("cooldown")
        else:
            stored.append(s[:4])
            if s[0] in MUTED_FAMILIES and not critical:
                out.append("muted")
            elif not critical and told.get(day(s[3]), 0) >= config.max_per_day:
                out.append("daily_cap")
            elif config.shadow:
                out.append("shadow")
            else:
                told[day(s[3])] = told.get(day(s[3]), 0) + 1
                out.append("delivered")
    return out


def listed(signals):
    rows = signals.select("family", "asset_id", "wallet", F.unix_micros("triggered_at").alias("us"), "significance").collect()
    return sorted(map(tuple, rows), key=lambda r: (-r[4], r[3], r[0], (r[1] is not None, r[1]), (r[2] is not None, r[2])))


def test_alert_decisions(spark):
    rows = listed(q_signals.k_actions(spark, SF))
    history = [(*r[:4], True) for r in rows if r[4] < 0.3]
    want = decide(rows, history, AlertConfig(max_per_run=200))
    got = [r.decision for r in QUERIES["alert_decisions"](spark, SF).orderBy("place").collect()]
    assert got == want and len(set(want)) >= 3


def test_stream_of_signals_is_decided_batch_by_batch(spark, tmp_path):
    signals = q_signals.k_actions(spark, SF).where("significance >= 0.3")
    rows = listed(signals)
    write = stream.alert_writer(str(tmp_path / "alerts"), AlertConfig(max_per_run=500, max_per_day=4))
    early = F.unix_micros("triggered_at") % 2 == 0
    write(signals.where(early), 0)
    write(signals.where(~early), 1)
    write(signals.where(~early), 1)  # a batch that runs again
    first, second = [r for r in rows if r[3] % 2 == 0], [r for r in rows if r[3] % 2]
    config = AlertConfig(max_per_run=500, max_per_day=4)
    one = decide(first, [], config)
    kept = [(*r[:4], d == "delivered") for r, d in zip(first, one, strict=True) if d not in ("duplicate", "threshold", "cooldown")]
    two = decide(second, kept, config)
    got = stream.decisions(spark, str(tmp_path / "alerts")).groupBy("decision").count().collect()
    every = one + two
    assert {r.decision: r["count"] for r in got} == {d: every.count(d) for d in set(every)}


def test_nightly_decisions(spark):
    """Every decision of a night, in order, against the policy taken signal by signal over the same history."""
    night = q_jobs.k_night(spark, SF)
    stored = q_signals.graded(spark, SF).select("family", "asset_id", F.unix_micros("triggered_at").alias("us")).collect()
    want = decide(listed(night.signals), [(r.family, r.asset_id, None, r.us, False) for r in stored], AlertConfig())
    decided = night.decisions.orderBy("place").collect()
    assert [(r.family, r.asset_id, r.wallet) for r in decided] == [r[:3] for r in listed(night.signals)[: AlertConfig().max_per_run]]
    assert [r.decision for r in decided] == want and len(set(want)) >= 2
    got = policy.dispatch_counts(night.decisions).first()
    assert {d: got[f"n_{d}"] for d in policy.DECISIONS} == {d: want.count(d) for d in policy.DECISIONS}


def test_a_night_detects_outcomes_once(spark, monkeypatch):
    """What it starts from holds no outcomes, so none are computed for it; its signals are those that the SQL grades."""
    calls = []
    monkeypatch.setattr(q_outcomes, "k_outcomes", lambda *a: calls.append(a))
    monkeypatch.setattr(q_jobs.sweep, "nightly", lambda *a, **k: a)
    night = q_jobs.k_night(spark, SF)
    assert not calls and night[3].count() == 0
    assert night[5].count() == night[5].select("signal_id").distinct().count() > 0


def test_replay_gives_what_every_moment_gives(spark):
    """Ticks of the replay against the families of the moment itself: texts, evidence and figures."""
    events, frozen, outcomes = adapters.clickstream_events(spark, SF), q_outcomes.tracked(spark, SF), q_outcomes.k_outcomes(spark, SF)
    step, end = 3 * 24 * HOUR, q_outcomes.AS_OF_US
    clock = replay.Clock(end - 2 * step, end, step)
    every = replay.all_families(events, frozen, outcomes, clock, q_graph.GRAPH, q_signals.SIGNAL)
    shown = lambda df: sorted(str(r) for r in df.withColumns({c: F.round(c, 9) for c in ("significance", "confidence")}).collect())
    for tick in (0, 2):
        at = F.timestamp_micros(F.lit(clock.start + tick * step))
        edges = gr.edges(events, frozen.select(F.col("wallet").alias("actor")), at, q_graph.GRAPH)
        start = F.timestamp_micros(F.lit(clock.start + (tick - 1) * step))
        want = sg.run_all(events, frozen, edges, outcomes, at, start, q_signals.SIGNAL)
        got = shown(every.where(F.col("evidence_cutoff") == at))
        assert got == shown(want) and len(got) > 5


def test_event_scans_do_not_grow_with_the_ticks(spark):
    events, frozen, outcomes = adapters.clickstream_events(spark, SF), q_outcomes.tracked(spark, SF), q_outcomes.k_outcomes(spark, SF)
    scans = []
    for n in (2, 30):
        end = q_outcomes.AS_OF_US
        found = replay.replay(events, frozen, outcomes, replay.Clock(end - (n - 1) * 24 * HOUR, end, 24 * HOUR), q_graph.GRAPH, q_signals.SIGNAL)
        scans.append(found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet"))
    assert scans[0] == scans[1]


def test_convergence_of_a_hot_asset(spark):
    """100,000 actors of one asset, related at random and in a chain: those that count are found as one after another would."""
    rng = random.Random(5)
    names = [f"a{i:06d}" for i in range(100_000)]
    pairs = {tuple(rng.sample(names, 2)) for _ in range(60_000)} | {(names[i + 1], names[i]) for i in range(12)}
    related = {}
    for a, b in pairs:
        related.setdefault(a, set()).add(b)
        related.setdefault(b, set()).add(a)
    counted = set()
    for a in names:
        if not related.get(a, set()) & counted:
            counted.add(a)
    at = F.lit("2024-01-05 00:00:00").cast("timestamp")
    events = spark.createDataFrame([(f"e{i}", a) for i, a in enumerate(names)], "event_id string, actor string")
    events = events.withColumns({"asset_id": F.lit("hot"), "side": F.lit("buy"), "observed_at": F.lit("2024-01-04 00:00:00").cast("timestamp")})
    edges = spark.createDataFrame(sorted(pairs), "source string, target string")
    got = sg.convergence(events, events.select(F.col("actor").alias("wallet")), edges, at).first()
    assert got.supporting_facts == [f"{len(counted)} of {len(names)} participating wallets have no detected relationship to each other"]
    assert len(got.evidence_ids) == 20
    plan = sg.convergence(events, events.select(F.col("actor").alias("wallet")), edges, at)._jdf.queryExecution().toString()
    assert "collect_set" not in plan
