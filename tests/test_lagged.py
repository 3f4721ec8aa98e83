"""Edges between actors, held against a loop over all pairs; what a task hands on does not grow with the meetings."""

import itertools
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklight.functions import lagged
from tracklight.operators import graph as gr
from tracklight.schema import DAY, GraphConfig

START = 1_704_067_200_000_000


def events_of(spark, rows):
    df = spark.createDataFrame([(a, k, START + t, "buy") for a, k, t in rows], "actor string, asset_id string, us long, side string")
    return df.withColumn("observed_at", F.timestamp_micros("us"))


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_edges_are_those_of_a_loop_and_no_row_per_meeting_is_written(spark, monkeypatch, most):
    monkeypatch.setattr(lagged, "MOST_MEETINGS", most)
    rng = np.random.default_rng(3)
    first = {}
    for _ in range(900):  # few moments, so that many are equal, and some are a whole lag apart
        a, k, t = f"a{rng.integers(40)}", f"é{rng.integers(30)}", int(rng.integers(12)) * DAY // 2
        first[a, k] = min(t, first.get((a, k), t))
    met, written, config = defaultdict(list), [], GraphConfig(max_lag_days=2, min_shared=3, evidence_assets=2)
    for ((a, k), s), ((b, j), u) in itertools.product(first.items(), repeat=2):
        if k == j and a != b and (s < u or (s == u and a < b)) and u - s <= 2 * DAY:
            met[a, b].append((k, u - s))
    wanted = {}
    for pair, found in met.items():
        if len(found) >= 3:
            later = sum(d > 0 for _, d in found) / len(found)
            wanted[pair] = (len(found), later, statistics.median(d / 1e6 for _, d in found), tuple(sorted(k for k, _ in found)[:2]), "leads" if later >= config.lead_consistency else "co_acquired")

    def keep(df):
        written.append(df.count())
        return df

    events = events_of(spark, [(a, k, t) for (a, k), t in first.items()])
    at = F.timestamp_micros(F.lit(START + 99 * DAY))
    got = {(r.source, r.target): (r.observations, r.ordering_consistency, r.median_lag_seconds, tuple(r.shared_assets), r.edge_type) for r in gr.edges(events, events.select("actor"), at, config, keep).collect()}
    assert len(wanted) > 100 and got == wanted
    assert sum(written) <= len(first)  # 900 rows at most; the meetings are many more


def test_no_actors_have_no_edges(spark):
    events = events_of(spark, [("a", "k", 0)])
    at = F.timestamp_micros(F.lit(START + DAY))
    assert gr.edges(events, events.select("actor").limit(0), at).collect() == []
    assert gr.edges(events, events.select("actor"), at).collect() == []
