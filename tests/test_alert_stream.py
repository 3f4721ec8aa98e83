"""The alert policy in keyed state, over many batches, against the loop."""

import os
import random

from pyspark.sql import functions as F

from tests.test_jobs import decide
from tracklight.schema import HOUR, AlertConfig
from tracklight.streaming import events as stream

SCHEMA = "family string, asset_id string, wallet string, triggered_at timestamp, significance double, risks array<string>"
FAMILIES = ("tracked_entity_action", "silent_accumulation", "pump_operator_activity", "sequence_confirmation")
START = 1_704_067_200_000_000


def batches(rng, n):
    """Signals of a few subjects over some days, batch by batch, each in the order of a run."""
    out = []
    for b in range(n):
        rows = []
        for _ in range(rng.randint(1, 12)):
            family = rng.choice(FAMILIES)
            us = START + (24 * (b // 4) + rng.choice([12, 22, 23, 24, 25])) * HOUR + rng.randrange(3600) * 1_000_000  # often around midnight
            rows.append((family, rng.choice(["x", "y", None]), None if family == "silent_accumulation" else rng.choice(["a", "b"]), us, round(rng.random(), 3)))
        rows = list({r[:4]: r for r in rows}.values())
        out.append(sorted(rows, key=lambda r: (-r[4], r[3], r[0], (r[1] is not None, r[1]), (r[2] is not None, r[2]))))
    return out


def test_twenty_batches_are_decided_as_the_loop_does(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    config, every = AlertConfig(max_per_day=3, max_per_run=10**6), batches(random.Random(4), 20)
    os.makedirs(tmp_path / "in")
    for i, rows in enumerate(every):
        df = spark.createDataFrame([(*r[:4], r[4], []) for r in rows], "family string, asset_id string, wallet string, us long, significance double, risks array<string>")
        df.withColumn("triggered_at", F.timestamp_micros("us")).drop("us").coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next(p for p in (tmp_path / f"b{i}").iterdir() if p.name.startswith("part-"))
        to = tmp_path / "in" / f"{i:02}.parquet"
        part.rename(to)
        os.utime(to, (1_000_000 + i, 1_000_000 + i))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    try:
        q = stream.alerts(source, config).writeStream.format("memory").queryName("alert_stream").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.family, r.asset_id, r.wallet, r.us, r.significance): r.decision for r in spark.table("alert_stream").collect()}
        sizes = [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress if p.numInputRows]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    history, want = [], {}
    for rows in every:
        made = decide(rows, history, config)
        want |= dict(zip(rows, made, strict=True))
        history += [(*r[:4], d == "delivered") for r, d in zip(rows, made, strict=True) if d not in ("duplicate", "threshold", "cooldown")]
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {}
    assert len(got) == len(want) and len(sizes) == 20 and set(want.values()) >= {"delivered", "duplicate", "threshold", "cooldown", "muted", "daily_cap"}
    assert sizes[-1] <= len(history) + 10


def test_batches_written_one_by_one_read_one_history(spark, tmp_path):
    config, every = AlertConfig(max_per_day=3, max_per_run=500), batches(random.Random(8), 4)
    write, history, want = stream.alert_writer(str(tmp_path / "alerts"), config), [], []
    for i, rows in enumerate(every):
        df = spark.createDataFrame([(*r[:4], r[4], []) for r in rows], "family string, asset_id string, wallet string, us long, significance double, risks array<string>")
        df = df.withColumns({"triggered_at": F.timestamp_micros("us"), "title": F.lit("t"), "supporting_facts": F.array().cast("array<string>")}).drop("us")
        write(df, i)
        if i == 2:
            write(df, i)  # a batch that runs again
        made = decide(rows, history, config)
        want += [(*r[:4], d) for r, d in zip(rows, made, strict=True)]
        history += [(*r[:4], d == "delivered") for r, d in zip(rows, made, strict=True) if d not in ("duplicate", "threshold", "cooldown")]
    got = stream.decisions(spark, str(tmp_path / "alerts")).select("family", "asset_id", "wallet", F.unix_micros("triggered_at"), "decision").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len([p for p in (tmp_path / "alerts").iterdir() if p.name.startswith("history=")]) == 2
