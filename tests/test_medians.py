"""Exact medians by counted ranges, and counts in pieces of time."""

import random
import statistics

from pyspark.sql import functions as F

from tracklight.functions.medians import medians, range_of
from tracklight.functions.temporal import counts_before

INF, NAN = float("inf"), float("nan")


def test_ranges_rise_with_the_values(spark):
    rng = random.Random(1)
    values = sorted([rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(3000)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, INF, -INF]) + [NAN]
    found = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", range_of(F.col("v")).alias("r")).orderBy("i").collect()
    assert all(a.r <= b.r for a, b in zip(found, found[1:], strict=False))


def test_medians_equal_sorting(spark):
    rng = random.Random(2)
    draw = [lambda: rng.choice([1.0, 1.0, 2.5]), lambda: rng.uniform(-3, 1000), lambda: rng.choice([None, 0.0, -7.0, 7.0]), lambda: float(rng.randrange(10**9)), lambda: rng.choice([INF, -INF, 3.0])]
    rows = [(k, rng.choice([None, "a"]), draw[k](), rng.choice([None, rng.random()])) for k in (0, 1, 2, 3, 4) for _ in range(rng.randrange(1, 80))]
    rows += [(9, "only nulls", None, None), (8, "one", 4.0, None)]
    table = spark.createDataFrame(rows, "k int, g string, x double, y double")
    got = {(r.k, r.g): (r.mx, r.my) for r in medians(table, ["k", "g"], {"mx": F.col("x"), "my": F.col("y")}).collect()}
    plain = {(r.k, r.g): (r.mx, r.my) for r in table.groupBy("k", "g").agg(F.median("x").alias("mx"), F.median("y").alias("my")).collect()}
    assert (9, "only nulls") not in got and got[8, "one"] == (4.0, None)
    plain = {k: v for k, v in plain.items() if v != (None, None)}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in plain.items()}
    for (k, g), (mx, _) in got.items():
        own = [r[2] for r in rows if r[:2] == (k, g) and r[2] is not None]
        assert repr(mx) == repr(statistics.median(own) if own else None)


def test_a_hot_group_is_divided_and_one_task_sees_few_rows(spark):
    rows = spark.range(0, 600_000, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 600_000 + 1).cast("double").alias("v"))
    assert medians(rows, ["k"], {"m": F.col("v")}).collect()[0].m == 300_000.5
    ranges = rows.groupBy("k", range_of(F.col("v")).alias("r")).count()
    assert ranges.count() < 4000  # what one task sees of the group as a whole
    assert ranges.where("count > 3000").count() == 0  # what is sorted, of 600,000 rows


def test_counts_before_equal_a_loop(spark):
    rng = random.Random(3)
    hour = 3_600_000_000
    rows = [(i, rng.choice(["hot", "cold", None]), rng.randrange(0, 3000), rng.randrange(0, 3)) for i in range(500)]
    table = spark.createDataFrame(rows, "id long, k string, at long, n int").withColumn("at", F.timestamp_micros(F.col("at") * hour))
    for bucket in (hour, 50 * hour, 10_000 * hour):
        got = {r.id: (r.a, r.b) for r in counts_before(table, ["k"], ["at", "id"], {"a": F.col("n"), "b": F.col("n") == 2}, bucket).collect()}
        for i, k, at, _ in rows:
            before = [n for j, q, t, n in rows if q == k and (t, j) < (at, i)]
            assert got[i] == (sum(before), before.count(2))


def test_turns_equal_a_loop(spark):
    from tracklight.operators import metrics as wm

    rng = random.Random(4)
    hour = 3_600_000_000
    rows = [
        (f"e{i:03}", rng.choice("xy"), rng.choice(["p", "q", None]), rng.randrange(0, 900), rng.choice(["buy", "buy", "sell", "long", None]), rng.choice(["swap", "swap", "liquidation"]), rng.choice([None, 5.0, 8.0, 13.0]))
        for i in range(400)
    ]
    table = spark.createDataFrame(rows, "event_id string, actor string, asset_id string, at long, side string, event_type string, usd_value double").withColumn("observed_at", F.timestamp_micros(F.col("at") * hour))
    hours, gains = {}, {}
    for actor in "xy":
        for asset in "pq":
            opened, spent = None, 0.0
            for _, _, _, at, side, kind, usd in sorted((r for r in rows if r[1:3] == (actor, asset)), key=lambda r: (r[3], r[0])):
                if side == "buy":
                    opened, spent = at if opened is None else opened, spent + (usd or 0.0)
                elif side == "sell" and opened is not None:
                    hours.setdefault(actor, []).append(at - opened)
                if side == "sell":
                    opened = None
                if usd is None or side == "buy":
                    continue
                gain = usd - spent if side == "sell" and spent > 0 else -usd if kind == "liquidation" else 0.0
                gains[actor] = gains.get(actor, 0.0) + gain
                spent = 0.0 if side == "sell" else spent
    for found in (wm.holding(table).collect(), wm.hold_hours(table).join(wm.realized_pnl(table), "actor").collect()):
        assert {r.actor: (r.median_hold_hours, r.episodes_closed) for r in found} == {a: (statistics.median(h), len(h)) for a, h in hours.items()}
        assert {r.actor: round(r.realized_pnl_usd, 6) for r in found} == {a: round(g, 6) for a, g in gains.items()}
