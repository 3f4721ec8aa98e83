import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.functions import temporal as tm

UTC = dt.UTC


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_event_key_is_stable_and_distinct(spark):
    r = one(spark, a=fn.event_key("solana", F.lit("tx"), "swap", 0), b=fn.event_key("solana", F.lit("tx"), "swap", 0), c=fn.event_key("solana", F.lit("tx"), "swap", 1))
    assert r.a == r.b != r.c and r.a.startswith("evt_") and len(r.a) == 36
    with pytest.raises(Exception, match="negative event index"):
        one(spark, a=fn.event_key("solana", F.lit("tx"), "swap", F.lit(-1)))


def test_addresses(spark):
    evm = "0x" + "aB" * 20
    r = one(spark, lower=fn.normalize_address(F.lit(f" {evm} "), F.lit("bsc")), bad=fn.normalize_address(F.lit("0x12"), F.lit("bsc")), kept=fn.normalize_address(F.lit("A" * 40), F.lit("solana")), none=fn.is_valid_address(F.lit(None).cast("string"), F.lit("bsc")))
    assert r.lower == evm.lower() and r.bad is None and r.kept == "A" * 40 and r.none is False
    assert one(spark, s=fn.display_address(F.lit("abcdefghijklmnop"))).s == "abcd…mnop"
    assert one(spark, s=fn.display_address(F.lit("abcdefghijk"))).s == "abcdefghijk"


def test_amounts(spark):
    r = one(spark, x=fn.scale_amount(F.lit(12345), F.lit(2)), y=fn.unscale_amount(F.lit(123.45), F.lit(2)), z=fn.scale_amount(F.lit(1), F.lit(37)))
    assert r.x == 123.45 and r.y == 12345 and r.z is None
    with pytest.raises(Exception, match="different decimals"):
        one(spark, a=fn.add_amounts(F.lit(1), F.lit(2), F.lit(1), F.lit(3)))


def test_rates(spark):
    r = one(spark, s=fn.shrink(F.lit(4), F.lit(4), F.lit(0.1)), none=fn.shrink(F.lit(0), F.lit(0), F.lit(0.1)), w=fn.wilson(F.lit(0), F.lit(0)), v=fn.wilson(F.lit(5), F.lit(10)))
    assert r.s == pytest.approx(4.8 / 12) and r.none == 0.1 and (r.w.lo, r.w.hi) == (0.0, 1.0)
    assert r.v.lo == pytest.approx(0.2366, abs=1e-4) and r.v.hi == pytest.approx(0.7634, abs=1e-4)


def test_texts_and_times(spark):
    r = one(
        spark, d=fn.defang(F.lit(" see\nhttps://x ")), k=fn.dedupe_key(F.lit("f"), F.lit(None).cast("string"), F.lit("w"), F.lit("2024-01-02 03:00:00").cast("timestamp")),
        p=fn.parse_utc(F.lit("2024-01-02 03:00:00")), q=fn.parse_utc(F.lit("2024-01-02T03:00:00Z")), wrap=fn.in_quiet_hours(F.lit("2024-01-02 03:00:00").cast("timestamp"), 22, 6), day=fn.in_quiet_hours(F.lit("2024-01-02 12:00:00").cast("timestamp"), 22, 6),
        b=fn.lookback_bucket(F.lit(1.5), (1, 7, 30)),
    )
    assert r.d == "see hxxps://x" and r.k == "f:-:w:20240102" and r.p is None and r.q is not None and r.wrap and not r.day and r.b == "7d"


@pytest.mark.parametrize(
    ("kind", "side", "filled", "usd", "stage"),
    [("order_placed", "long", False, 9.0, "bidding"), ("liquidation", None, True, 9.0, "aborted"), ("swap", "buy", True, 1.0, "probing"), ("swap", "buy", True, 50.0, "accumulating"), ("position_opened", "long", True, None, "probing"), ("swap", "sell", True, 5.0, "distributing"), ("transfer", None, True, 5.0, None)],
)
def test_stages(spark, kind, side, filled, usd, stage):
    got = fn.stage_of(F.lit(kind), F.lit(side).cast("string"), F.lit(filled), F.lit(usd).cast("double"), F.lit(100.0))
    assert one(spark, s=got).s == stage


def test_significance_is_relative_to_the_actor(spark):
    sizes = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4, 500)])
    big = fn.significance(sizes, F.lit(500.0), F.lit("position_opened"), F.lit(60.0), F.lit(2.0))
    small = fn.significance(sizes, F.lit(1.0), F.lit("swap"), F.lit(0.0), F.lit(90.0))
    r = one(spark, a=big, b=small)
    assert r.a.score == pytest.approx(1.0) and len(r.a.reasons) == 4 and r.b.score == pytest.approx(0.07) and r.b.reasons == []


def test_asof_join_takes_the_last_row_not_after(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 5, 3)], "k string, at long, id int")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0), ("b", 6, 3.0)], "k string, at long, v double")
    loose = {r.id: r.v for r in tm.asof_join(left, right, "at", ["k"], ["v"]).collect()}
    strict = {r.id: r.v for r in tm.asof_join(left, right, "at", ["k"], ["v"], strict=True).collect()}
    assert loose == {1: 1.0, 2: 2.0, 3: None} and strict == {1: None, 2: 2.0, 3: None}


def test_range_join_equals_brute_force(spark):
    points = [("a", i * 7 % 50) for i in range(40)]
    spans = [("a", i, i + 9) for i in range(0, 60, 4)]
    got = tm.range_join(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, s long, e long"), ["k"], "at", "s", "e", bucket=5)
    assert sorted((r.at, r.s) for r in got.collect()) == sorted((p, s) for _, p in points for _, s, e in spans if s <= p < e)


def test_previous_action_leaves_ties_out(spark):
    t = lambda n: dt.datetime(2024, 1, 1, n, tzinfo=UTC).replace(tzinfo=None)
    rows = spark.createDataFrame([("a", t(1)), ("a", t(1)), ("a", t(3))], "actor string, observed_at timestamp")
    assert sorted(str(r.previous_at) for r in tm.previous_action(rows).collect()) == sorted(["None", "None", str(t(1))])
