"""A small planted world: each actor follows one pattern, and the analytics must tell them apart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracklight.operators import backtest as bt
from tracklight.operators import discovery as ds
from tracklight.operators import graph as gr
from tracklight.operators import metrics as wm
from tracklight.operators import nightly as nl
from tracklight.operators import outcomes as oc
from tracklight.operators import playbooks as pb
from tracklight.operators import policy, sinks
from tracklight.operators import signals as sg
from tracklight.schema import AlertConfig, OutcomeConfig

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id string, event_type string, chain_time timestamp, observed_at timestamp, finality string, actor string, asset_id string, side string, usd_value double, price_usd double, filled boolean"
OUTCOME = "outcome_id string, outcome_class string, asset_id string, t0 timestamp, first_observed_at timestamp, magnitude double"


def day(n):
    return T0 + dt.timedelta(days=n)


def world():
    events, outcomes, assets = [], [], []

    def act(actor, asset, at, kind="swap", side="buy", usd=100.0, filled=True):
        events.append((f"e{len(events):05d}", kind, day(at), day(at), "finalized", actor, asset, side, usd, 1.0, filled))

    for i in range(200):
        assets.append((f"n:d{i}", day(0)))
    for i in range(8):  # listings, 42 days apart
        asset, t0 = f"n:l{i}", 30 + 42 * i
        assets.append((asset, day(t0 - 25)))
        outcomes.append((f"o{asset}", "cex_listing", asset, day(t0), day(t0 + 0.1), None))
        act("creator", asset, t0 - 25, "token_created", None, None)
        act("listing", asset, t0 - 21, "position_opened", "long", 500.0)
        act("listing", asset, t0 - 20.3, "liquidation", None, 500.0)
        act("listing", asset, t0 - 9, "order_placed", "long", 4000.0, False)
        act("listing", asset, t0 - 6, usd=5000.0)
        act("follower", asset, t0 - 5.25, usd=900.0)
        act("listing", asset, t0 - 2, side="sell", usd=2000.0)
    for i in range(10):  # fresh assets that a machine buys at once
        asset = f"n:s{i}"
        assets.append((asset, day(10 * i)))
        act("creator", asset, 10 * i, "token_created", None, None)
        act("sniper", asset, 10 * i + 1.2 / 86400)
    for i in range(6):  # quick pumps
        asset, t0 = f"n:p{i}", 60 + 30 * i
        assets.append((asset, day(t0 - 10)))
        outcomes += [(f"r{asset}", "price_run", asset, day(t0), day(t0 + 0.25), 4.0), (f"c{asset}", "rug_or_collapse", asset, day(t0 + 2), day(t0 + 2.25), 0.9)]
        act("operator", asset, t0 - 4)
        act("operator", asset, t0 + 20 / 24, side="sell", usd=300.0)
    for i in range(3):
        act("lucky", f"n:l{i}", 29 + 42 * i)
    for k in range(400):
        act("churner", f"n:d{k % 200}", 1 + k / 10)
    return events, outcomes, assets


@pytest.fixture(scope="module")
def planted(spark):
    events, outcomes, assets = world()
    return (
        spark.createDataFrame(events, EVENT).cache(), spark.createDataFrame(outcomes, OUTCOME).cache(), spark.createDataFrame(assets, "asset_id string, first_seen_at timestamp").cache(),
    )


def as_of(n=400):
    return F.lit(day(n))


def test_insiders_pass_and_decoys_do_not(planted):
    scores = {r.actor: r for r in ds.sweep(*planted, as_of()).collect()}
    passed = {a for a, r in scores.items() if r.passed}
    assert passed == {"listing", "follower", "operator"}
    assert scores["listing"].archetype == "listing_predictor" and scores["operator"].archetype == "pump_operator"
    assert scores["lucky"].rejection_reason.startswith("too_few_events:3")
    assert scores["listing"].independent_events == 8 and scores["listing"].edge_ratio > 5


def test_metrics(planted):
    rows = {r.actor: r for r in wm.wallet_metrics(*planted, as_of()).collect()}
    assert rows["sniper"].archetype == "bot" and rows["sniper"].excluded_reason == "entered_within_30s_of_launch_10_times"
    assert rows["churner"].archetype in ("high_frequency", "bot")
    assert rows["operator"].median_hold_hours == pytest.approx(116.0) and rows["listing"].liquidations == 8 and rows["listing"].resting_orders == 8
    assert rows["listing"].realized_pnl_usd == pytest.approx(8 * (2000 - 5000) - 8 * 500)
    assert rows["listing"].median_buyer_rank == 0.0 and rows["creator"].archetype == "unclassified"


def test_what_was_seen_later_does_not_count(planted):
    early = ds.appearances(planted[0], oc.observable(planted[1], as_of(100), ("cex_listing", "price_run")))
    late = ds.appearances(planted[0], oc.observable(planted[1], as_of(400), ("cex_listing", "price_run")))
    assert early.join(late, ["actor", "outcome_id"], "left_anti").count() == 0 and early.count() < late.count()
    assert early.where("entered_at >= t0").count() == 0
    assert ds.negative_control(planted[0], wm.wallet_metrics(*planted, as_of())).count() > 0


def test_independence_folds_what_is_close(spark):
    rows = [("close", f"a{i}", day(i)) for i in range(8)] + [("apart", f"a{i}", day(30 * i)) for i in range(5)] + [("same", "a", day(40 * i)) for i in range(4)]
    got = {r.actor: r.independent_events for r in ds.independent_events(spark.createDataFrame(rows, "actor string, asset_id string, t0 timestamp")).collect()}
    assert got == {"close": 1, "apart": 5, "same": 1}


def test_leaders_come_before_followers(planted, spark):
    wallets = spark.createDataFrame([("listing",), ("follower",), ("lucky",)], "actor string")
    edges = {(r.source, r.target): r for r in gr.edges(planted[0], wallets, as_of()).collect()}
    edge = edges["listing", "follower"]
    assert edge.edge_type == "leads" and edge.observations == 8 and edge.confidence == 0.85 and ("follower", "listing") not in edges
    near = gr.neighborhood(spark.createDataFrame(list(edges.values())), "follower", 1)
    assert near.where("source = 'listing' AND target = 'follower' AND hop = 1").count() == 1


def test_retraction_keeps_history(spark):
    members = spark.createDataFrame([("x", "a", day(0), None)], "entity_id string, wallet string, valid_from timestamp, valid_to timestamp")
    more = gr.add_members(members, spark.createDataFrame([("x", "a", day(3)), ("x", "b", day(3))], "entity_id string, wallet string, valid_from timestamp"))
    assert more.count() == 2
    after = gr.retract_members(more, spark.createDataFrame([("x", "a", day(5))], "entity_id string, wallet string, at timestamp"))
    assert after.count() == 2 and gr.members_at(after, as_of(4)).count() == 2 and [r.wallet for r in gr.members_at(after, as_of(6)).collect()] == ["b"]


def test_playbook_of_the_insider(planted, spark):
    members = spark.createDataFrame([("x", "listing", True), ("x", "follower", False)], "entity_id string, wallet string, is_primary boolean")
    seqs = pb.sequences(pb.staged_events(planted[0], members, as_of()), planted[1], as_of())
    assert seqs.where("completed").count() == 8
    book = pb.playbooks(seqs).first()
    assert book.stages == ["probing", "bidding", "accumulating", "confirming", "distributing"] or book.stages == ["bidding", "accumulating", "confirming", "distributing"]
    assert book.median_stage_lags["bidding"] == 9.0 and book.supporting == 8
    assert pb.playbooks(seqs.limit(2)).count() == 0


def candle(spark, closes, volume=1000.0, step=1):
    return spark.createDataFrame([("n:a", day(i * step), float(c), volume) for i, c in enumerate(closes)], "asset_id string, start timestamp, close double, volume double")


def test_detectors(spark):
    run = candle(spark, [1] * 9 + [3.5, 9])
    assert [(r.t0, r.magnitude) for r in oc.price_runs(run).collect()] == [(day(9), 3.5)]
    assert oc.price_runs(candle(spark, [1] * 9 + [3.5], volume=1.0)).count() == 0 and oc.price_runs(candle(spark, [1, 9])).count() == 0
    fall = candle(spark, [1] * 9 + [4, 0.5, 0.4])
    assert [r.t0 for r in oc.collapses(fall).collect()] == [day(10)]
    pump = oc.pump_events(fall).first()
    assert pump.evidence["hours_to_collapse"] == "24.0" and pump.t0 == day(9) and pump.evidence["run_outcome_id"] == oc.price_runs(fall).first().outcome_id
    wake = candle(spark, [1] * 80 + [6] * 3, volume=100.0)
    woken = oc.revivals(wake).first()
    assert woken.t0 == day(66) and woken.magnitude == 6.0  # the first candle whose next 14 days hold the peak
    assert oc.detect_all(fall.limit(0), OutcomeConfig()).count() == 0


def test_base_rates_count_the_whole_universe(planted):
    rates = {r.outcome_class: r for r in oc.base_rates(planted[1], planted[2], as_of(), ("cex_listing", "price_run", "revival")).collect()}
    assert (rates["cex_listing"].hits, rates["cex_listing"].total) == (8, 224) and rates["revival"].rate == 0


def test_merge_is_idempotent(planted, spark):
    events = planted[0]
    stored = sinks.upsert_events(events.limit(0), events)
    again = sinks.upsert_events(stored, events)
    assert again.count() == events.count() and again.exceptAll(events).count() == 0
    late = events.limit(1).withColumn("finality", F.lit("reverted")).withColumn("usd_value", F.lit(1.0))
    after = sinks.upsert_events(stored, late)
    changed = after.where("finality = 'reverted'").first()
    assert after.count() == events.count() and changed.usd_value != 1.0
    counts = sinks.upsert_counts(stored, late).first()
    assert (counts.seen, counts.written, counts.duplicates, counts.reverted) == (1, 0, 1, 1)
    good, bad = sinks.split_dead_letters(events.withColumn("actor", F.when(F.col("actor") == "lucky", None).otherwise(F.col("actor"))))
    assert bad.count() == 3 and good.count() == events.count() - 3


def alert_oracle(rows, history, c):
    out, keys, kept, told = [], {h[4] for h in history}, [(h[:3], h[3]) for h in history], {}
    for h in history:
        if h[5]:
            told[h[3].date()] = told.get(h[3].date(), 0) + 1
    for family, asset, wallet, at, sig in rows[: c.max_per_run]:
        key, subject, critical = (family, asset, wallet, at.date()), (family, asset, wallet), family == "pump_operator_activity"
        if key in keys:
            out.append("duplicate")
            continue
        if sig < c.threshold and not critical:
            out.append("threshold")
            continue
        if not critical and any(s == subject and dt.timedelta() <= at - t <= dt.timedelta(hours=c.cooldown_hours) for s, t in kept):
            out.append("cooldown")
            continue
        keys.add(key)
        kept.append((subject, at))
        if family == "silent_accumulation":
            out.append("muted")
        elif not critical and told.get(at.date(), 0) >= c.max_per_day:
            out.append("daily_cap")
        else:
            told[at.date()] = told.get(at.date(), 0) + 1
            out.append("delivered")
    return out


def test_alert_decisions_equal_a_loop(spark):
    import random

    rng = random.Random(9)
    families = ["tracked_entity_action", "silent_accumulation", "pump_operator_activity", "independent_convergence"]
    rows = sorted({(rng.choice(families), rng.choice(["n:a", "n:b", None]), rng.choice(["w", None]), T0 + dt.timedelta(minutes=rng.randint(0, 3000)), round(rng.random(), 3)) for _ in range(200)} | {("tracked_entity_action", "n:a", "w", T0 + dt.timedelta(hours=49), 0.999)}, key=lambda r: (-r[4], r[3], r[0], r[1] or "", r[2] or ""))
    past = [("tracked_entity_action", "n:a", "w", T0 + dt.timedelta(hours=46), ("tracked_entity_action", "n:a", "w", (T0 + dt.timedelta(hours=46)).date()), True)]
    config = AlertConfig(max_per_run=190, max_per_day=4)
    signals = spark.createDataFrame([(*r, []) for r in rows], "family string, asset_id string, wallet string, triggered_at timestamp, significance double, risks array<string>")
    history = spark.createDataFrame([(*h[:4], h[5]) for h in past], "family string, asset_id string, wallet string, triggered_at timestamp, delivered boolean")
    got = [r.decision for r in policy.dispatch(signals, history, config).orderBy("place").collect()]
    assert got == alert_oracle(rows, past, config) and {"delivered", "cooldown", "muted", "daily_cap", "threshold"} <= set(got)


def test_convergence_counts_only_unrelated(planted, spark):
    tracked = spark.createDataFrame([("listing", "x", 5.0), ("follower", "x", 5.0), ("lucky", "x", 5.0)], "wallet string, archetype string, edge_vs_base double")
    related = spark.createDataFrame([("listing", "follower")], "source string, target string")
    none = related.limit(0)
    at = F.lit(day(29.0))
    free = sg.convergence(planted[0], tracked, none, at).collect()
    bound = sg.convergence(planted[0], tracked, related, at).collect()
    assert free[0].title.startswith("3 independent") and bound[0].title.startswith("2 independent")


def test_grading_and_proposals(spark):
    signals = spark.createDataFrame([("1", "f", "n:a", day(1), 0.9, "pending"), ("2", "f", "n:b", day(1), 0.2, "pending"), ("3", "f", None, day(1), 0.5, "pending"), ("4", "f", "n:b", day(39), 0.5, "pending"), ("5", "f", "n:a", day(9), 0.5, "miss")], "signal_id string, family string, asset_id string, triggered_at timestamp, significance double, grade string")
    outcomes = spark.createDataFrame([("o", "price_run", "n:a", day(30), day(30.5), 3.0)], OUTCOME)
    graded = nl.grade(signals, outcomes, as_of(40))
    assert {r.signal_id: r.grade for r in graded.collect()} == {"1": "hit", "2": "miss", "3": "not_applicable", "4": "pending", "5": "miss"}
    many = spark.createDataFrame([(0.4, "miss")] * 30 + [(0.6, "hit")] * 20, "significance double, grade string")
    assert nl.threshold_proposal(many).first().proposed == 0.45
    assert nl.threshold_proposal(many.limit(5)).first().proposed == 0.35


def test_backtest(spark):
    candles = candle(spark, [1, 2, 4, 8])
    entries = spark.createDataFrame([("a", "n:a", day(0)), ("b", "n:a", day(-5)), ("c", "n:zz", day(1))], "entry_id string, asset_id string, signal_at timestamp")
    filled = bt.fills(entries, candles)
    assert {r.entry_id: r.rejected_reason for r in filled.collect()} == {"a": None, "b": "no_price_at_entry", "c": "no_price_at_entry"}
    trade = bt.returns(filled, candles).first()
    assert trade.exit_price == 8.0 and trade.pnl_usd == pytest.approx(1000 * (8 - 1.015) / 1.015 - 3)
    assert bt.summary(filled, bt.returns(filled, candles)).first().rejected == 2
