"""Compaction of the event table: only the buckets that batches touch are written anew."""

from pyspark.sql import functions as F

from tracklight.streaming import events as stream

ROWS = "event_id string, event_type string, actor string, observed_at timestamp, finality string, usd_value double"


def batch(spark, ids, finality, day, value=1.0):
    rows = [(f"e{i}", "swap", "a", f"2024-01-{day:02} 00:00:00", finality, value) for i in ids]
    return spark.createDataFrame(rows, ROWS.replace("observed_at timestamp", "observed_at string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in (path / "data").rglob("part-*.parquet")}


def state(spark, path):
    return {r.event_id: (r.finality, r.usd_value) for r in stream.current(spark, str(path)).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    write = stream.table_writer(spark, str(tmp_path))
    write(batch(spark, range(200), "pending", 1), 0)
    assert stream.compact(spark, str(tmp_path), buckets=8) and not stream.compact(spark, str(tmp_path), buckets=8)
    first = files(tmp_path)
    assert len(first) == 8
    want = {f"e{i}": ("pending", 1.0) for i in range(200)}
    assert state(spark, tmp_path) == want
    write(batch(spark, [7], "finalized", 2, 5.0), 1)
    write(batch(spark, [7], "finalized", 2, 5.0), 1)  # a batch that runs again
    want["e7"] = ("finalized", 1.0)  # only the finality of a known event changes
    assert state(spark, tmp_path) == want
    assert stream.compact(spark, str(tmp_path))
    second = files(tmp_path)
    assert {p: t for p, t in second.items() if p in first} == first and len(second) - len(first) == 1
    assert state(spark, tmp_path) == want
    write(batch(spark, range(200, 260), "pending", 3), 2)
    write(batch(spark, [], "pending", 3), 3)
    assert stream.compact(spark, str(tmp_path)) and len(files(tmp_path)) <= len(second) + 8
    assert state(spark, tmp_path) == want | {f"e{i}": ("pending", 1.0) for i in range(200, 260)}
