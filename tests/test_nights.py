"""Published nights: together or not at all, once, in order; what is stored of candidates stays."""

import pytest
from pyspark.sql import functions as F

from tracklight.operators import discovery as ds
from tracklight.operators import nights


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def listed(df):
    return sorted(r.x for r in df.collect())


def test_nights_are_published_once_and_in_order(spark, tmp_path):
    state = nights.Nights(spark, str(tmp_path / "n"))
    assert state.keys() == []
    assert state.publish("2024-01-01", {"now": rows(spark, 1)}, {"all": rows(spark, 1)})
    assert not state.publish("2024-01-01", {"now": rows(spark, 9)}, {"all": rows(spark, 9)})
    assert state.publish("2024-01-02", {"now": rows(spark, 2, 3)}, {"all": rows(spark, 2), "new": rows(spark)})
    assert state.keys() == ["2024-01-01", "2024-01-02"]
    assert listed(state.read("now", "2024-01-02")) == [2, 3] and listed(state.read("all", "2024-01-02")) == [1, 2]
    assert listed(state.read("now", "2024-01-01")) == [1] and listed(state.read("all", "2024-01-01")) == [1]
    assert listed(state.read("new", "2024-01-02")) == [] and state.read("new", "2024-01-01") is None
    with pytest.raises(ValueError, match="comes after"):
        state.publish("2023-12-31", {}, {"all": rows(spark, 0)})


def test_a_night_that_fails_leaves_nothing_to_see(spark, tmp_path):
    state = nights.Nights(spark, str(tmp_path / "n"))
    state.publish("a", {"now": rows(spark, 1)}, {})
    broken = rows(spark, 1).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))
    with pytest.raises(Exception, match="lost"):
        state.publish("b", {"now": rows(spark, 2), "z": broken}, {})
    assert state.keys() == ["a"] and listed(state.read("now", "a")) == [1]
    assert state.publish("b", {"now": rows(spark, 3)}, {}) and listed(state.read("now", "b")) == [3]


def test_of_two_writers_of_a_night_one_gets_through(spark, tmp_path, monkeypatch):
    state = nights.Nights(spark, str(tmp_path / "n"))
    real, calls = state.keys, []

    def late():  # the other writer publishes after this one has looked
        calls.append(1)
        return real() if len(calls) > 1 else []

    assert nights.Nights(spark, state.path).publish("a", {"now": rows(spark, 1)}, {})
    monkeypatch.setattr(state, "keys", late)
    assert not state.publish("a", {"now": rows(spark, 2)}, {})
    assert listed(state.read("now", "a")) == [1]
    left = [p.name for p in (tmp_path / "n").iterdir() if p.name.startswith("_draft")]
    assert left == [] and len(list((tmp_path / "n" / "data").iterdir())) == 1


SCORED = (
    "actor string, passed boolean, hits long, edge_ratio double, archetype string, hit_rate double, shrunk_hit_rate double, base_rate double, touched long, independent_events long, rejection_reason string"
)


def test_a_sweep_keeps_the_provenance_that_is_stored(spark):
    at = F.lit("2024-01-05 00:00:00").cast("timestamp")
    scores = spark.createDataFrame([("a", True, 4, 2.0, None, 0.5, 0.5, 0.1, 8, 3, None), ("b", False, 1, 0.5, None, 0.1, 0.1, 0.1, 8, 1, "too_few_events"), ("c", False, 0, 0.1, None, 0.1, 0.1, 0.1, 8, 1, "too_few_events")], SCORED)
    moment = "timestamp '2024-01-01 00:00:00'"
    appearing = spark.sql(f"SELECT 'a' AS actor, {moment} AS t0, 'o1' AS outcome_id, 'bsc:x' AS asset_id, 'price_run' AS outcome_class, {moment} AS entered_at, 1.5D AS lead_time_days, '3d' AS window")
    config = ds.DiscoveryConfig(near_misses=1)
    empty = spark.createDataFrame([], ds.CANDIDATES)
    assert ds.persist_counts(empty, scores, config).first().asDict() == {"surfaced": 1, "updated": 0, "rejected": 2, "rejections_recorded": 1}
    first = ds.persist(empty, scores, at, config, appearing)
    again = ds.persist(first, scores, at, config)
    for found in (first, again):
        kept = {r.wallet: r for r in found.collect()}
        assert set(kept) == {"a", "b"} and kept["a"].network == "bsc" and [p.outcome_id for p in kept["a"].discovery_provenance] == ["o1"]
    assert ds.persist_counts(first, scores, config).first().asDict() == {"surfaced": 0, "updated": 2, "rejected": 1, "rejections_recorded": 0}
