"""As-of joins and sums in pieces: the same as in one pass, and a hot key on several tasks."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tracklight.functions import temporal as tp

HOUR = 3_600_000_000


def tables(spark, seed, keys=("hot", "cold", None)):
    rng = random.Random(seed)
    left = [(i, rng.choice(keys), rng.choice([None, rng.randrange(-50, 1000)])) for i in range(400)]
    right = [(rng.choice(keys), rng.choice([None, rng.randrange(-50, 1000)]), rng.choice([None, 1.5, 2.5])) for _ in range(150)]
    return left, right, spark.createDataFrame(left, "id long, k string, at long"), spark.createDataFrame(right, "k string, at long, v double")


@pytest.mark.parametrize("bucket", [None, 7, 100, 5000])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_equals_a_search(spark, bucket, strict):
    left, right, l, r = tables(spark, 3)
    got = {x.id: x.v for x in tp.asof_join(l, r, "at", ["k"], ["v"], strict, bucket).collect()}
    order = lambda x: (x[1], x[2] is not None, x[2] or 0)
    for i, k, at in left:
        before = sorted((x for x in right if x[0] == k and at is not None and x[1] is not None and (x[1] < at if strict else x[1] <= at)), key=order)
        assert got[i] == (before[-1][2] if before else None), (i, k, at)
    assert len(got) == len(left)


def test_next_after_and_sums_before(spark):
    left, right, l, r = tables(spark, 5, ("hot", "cold"))
    stamp = lambda df: df.where("at IS NOT NULL").withColumn("at", F.timestamp_micros(F.col("at") * HOUR))
    events = stamp(r).withColumns({"then": F.col("at"), "name": F.col("v").cast("string")})
    got = {x.id: (x.then, x.name) for x in tp.next_after(stamp(l), events.withColumnRenamed("at", "when"), "at", "when", ["k"], ["then", "name"], bucket=50 * HOUR).collect()}
    sums = {x.id: x.before for x in tp.sums_before(stamp(l).withColumn("n", F.col("id").cast("int")), ["k"], "at", "n", "before", bucket=70 * HOUR).collect()}
    for i, k, at in left:
        if at is None:
            continue
        later = sorted(((x[1], x[2] is not None, x[2] or 0) for x in right if x[0] == k and x[1] is not None and x[1] > at))
        assert got[i][1] == ((str(later[0][2]) if later[0][1] else None) if later else None) and (got[i][0] is None) == (not later)
        assert sums[i] == sum(j for j, q, t in left if q == k and t is not None and t < at)


def test_a_hot_key_is_divided_among_tasks(spark):
    points = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 100_000).alias("at"), "id")
    quotes = spark.range(5_000).select(F.lit("hot").alias("k"), (F.col("id") * 20).alias("at"), F.col("id").cast("double").alias("v"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = tp.asof_join(points, quotes, "at", ["k"], ["v"], bucket=1000).withColumn("task", F.spark_partition_id())
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    starts = [i * 20 for i in range(5_000)]
    assert all(r.v == float(bisect.bisect_right(starts, r.at) - 1) for r in rows)
    per = {}
    for r in rows:
        per[r.task] = per.get(r.task, 0) + 1
    assert len(per) >= 4 and max(per.values()) < len(rows) / 2
