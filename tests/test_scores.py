"""Scores of discovery do not depend on the order in which rows are added."""

from itertools import permutations

from pyspark.sql import functions as F

from tracklight.operators import discovery as ds

RATES = {"price_run": 0.1, "revival": 0.2, "cex_listing": 0.3}


def test_actors_with_the_same_mix_of_classes_tie(spark):
    """Each order of the three classes, once and three times over: sums of doubles would differ in their last bit."""
    mixes = {f"a{i:02}": list(order) * (1 + 2 * (i % 2)) for i, order in enumerate([*permutations(RATES), *permutations(RATES)][:11])}
    rows = [(actor, f"{actor}-{k}", c, f"k:{k % 3}", 1704067200 + k, 1.0) for actor, classes in mixes.items() for k, c in enumerate(classes)]
    appearing = spark.createDataFrame(rows, "actor string, outcome_id string, outcome_class string, asset_id string, t long, lead_time_days double").coalesce(1).withColumn("t0", F.timestamp_seconds("t"))
    metrics = spark.createDataFrame([(a, 10, "trader", None) for a in mixes], "actor string, distinct_tokens long, archetype string, excluded_reason string")
    rates = spark.createDataFrame(list(RATES.items()), "outcome_class string, rate double")
    scored = ds.score(appearing, metrics, rates).orderBy(F.desc("edge_ratio"), "actor").collect()
    assert [r.actor for r in scored] == sorted(mixes)
    assert {r.base_rate for r in scored} == {0.2} and len({r.edge_ratio for r in scored}) == 1


def test_guards_compare_sums_of_doubles_as_sql_does(spark):
    """Actors right at a bound: 3 hits of 15 at a rate of 0.2 shrink to exactly 0.2, which is not below it. The others are held against a loop."""
    rates = {"c20": 0.2, "c21": 0.21, "c15": 0.15, "c95": 0.95, "c100": 1.0}
    mixes = {f"{c}-{n}-{touched}": ([c] * n, touched) for c in rates for n in range(2, 9) for touched in (*range(n, 6 * n), 5 * n + 1)}
    mixes |= {f"mix-{n}-{touched}": (["c100"] * n + ["c20", "c95"] * (n // 2), touched) for n in range(2, 9) for touched in range(n, 30)}
    rows = [(a, f"{a}-{k}", c, f"k:{k}", 1704067200 + k, 1.0) for a, (classes, _) in mixes.items() for k, c in enumerate(classes)]
    appearing = spark.createDataFrame(rows, "actor string, outcome_id string, outcome_class string, asset_id string, t long, lead_time_days double").withColumn("t0", F.timestamp_seconds("t"))
    metrics = spark.createDataFrame([(a, touched, "trader", None) for a, (_, touched) in mixes.items()], "actor string, distinct_tokens long, archetype string, excluded_reason string")
    config = ds.DiscoveryConfig(min_events=2, min_independent=1, min_edge=0.8, min_shrunk=0.2)
    got = {r.actor: r.rejection_reason for r in ds.score(appearing, metrics, spark.createDataFrame(list(rates.items()), "outcome_class string, rate double"), config).collect()}

    def reason(classes, touched):
        total = 0.0
        for rate in sorted(rates[c] for c in classes):
            total += rate
        base, hits = total / len(classes), len(classes)
        shrunk = (hits + 8 * base) / (max(touched, hits) + 8)
        return "edge_vs_base_rate" if shrunk / base < 0.8 else "shrunk_hit_rate" if shrunk < 0.2 else None

    assert got["c20-3-15"] is None
    assert {a: r and r.split(":")[0] for a, r in got.items()} == {a: reason(*m) for a, m in mixes.items()}
