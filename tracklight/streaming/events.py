"""Event streams: idempotent intake, late finality, dead letters, watched actors, trailing windows, alert state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracklight.functions import scalars as fn
from tracklight.functions import tables
from tracklight.operators import policy, sinks
from tracklight.schema import HOUR, MUTED_FAMILIES, AlertConfig
from tracklight.sources import scans


def deduplicated(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (event_id, finality) once within the bound for late rows, so that a later finality still gets through."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["event_id", "finality"])


DELIVERED = "_delivered"  # the batch that a row came with


def table_writer(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds to the event table in ``path``.

    A batch writes its own rows only, to a folder that its number names, so a batch that runs again writes the same
    folder, and the work of a batch does not grow with the table. ``current`` merges; ``compact`` keeps that short.
    Dead letters go beside them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = sinks.split_dead_letters(batch)
        bad.write.mode("overwrite").parquet(f"{path}/dead/{batch_id}")
        good.withColumn(DELIVERED, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/delta={batch_id}")

    return write


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Of the finished folders ``kind=N`` the numbers, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    done = [n for n in names if n.startswith(f"{kind}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


BASE = "bucket int, buckets int, folder string"


def _base(spark: SparkSession, path: str) -> tuple[int, list]:
    """(the last batch that is merged, or -1; the rows of the base's list: a folder for each bucket of ids)."""
    found = _numbers(spark, path, "base")
    return (found[-1], spark.read.schema(BASE).json(f"{path}/base={found[-1]}").collect()) if found else (-1, [])


def _merged(spark: SparkSession, path: str, after: int, folders: list[str], sequence: str) -> DataFrame | None:
    """The rows of the base's ``folders``, and the batches after the number ``after`` merged in, in their order."""
    deltas = [f"{path}/delta={n}" for n in _numbers(spark, path, "delta") if n > after]
    base = spark.read.parquet(*folders) if folders else None
    if not deltas:
        return base
    new = spark.read.parquet(*deltas).withColumn("_sequence", F.struct(DELIVERED, sequence))
    stored = new.limit(0).drop("_sequence", DELIVERED) if base is None else base
    return sinks.upsert_events(stored, new, "_sequence")


def current(spark: SparkSession, path: str, sequence: str = "observed_at") -> DataFrame | None:
    """The event table: the last compacted one, and the batches after it merged in. None if there is nothing."""
    last, rows = _base(spark, path)
    return _merged(spark, path, last, [r["folder"] for r in rows], sequence)


def compact(spark: SparkSession, path: str, sequence: str = "observed_at", buckets: int = 64) -> bool:
    """Merge the batches into the base of later reads. False if there is none to merge.

    The base is kept in buckets by the hash of the id, and only those that the batches touch are written anew; the list of
    the buckets' folders, written last, makes them the base. So the work is that of the batches and their buckets; the
    first compaction sets the number of buckets. Older folders stay, for readers at work, until they are deleted.
    """
    last, rows = _base(spark, path)
    deltas = [n for n in _numbers(spark, path, "delta") if n > last]
    if not deltas:
        return False
    buckets = rows[0]["buckets"] if rows else buckets
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int")
    new = spark.read.parquet(*[f"{path}/delta={n}" for n in deltas])
    touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # at most one row per bucket
    folders = {r["bucket"]: r["folder"] for r in rows}
    if touched:
        merged = _merged(spark, path, last, [folders[b] for b in touched if b in folders], sequence).withColumn("_bucket", bucket)
        data = f"{path}/data/{deltas[-1]}"
        merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
        folders |= {b: f"{data}/_bucket={b}" for b in touched}
    listed = [(b, buckets, f) for b, f in sorted(folders.items())]
    spark.createDataFrame(listed, BASE).coalesce(1).write.mode("overwrite").json(f"{path}/base={deltas[-1]}")
    return True


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the event table in ``path`` up to date with everything the stream holds now."""
    writer = table_writer(stream.sparkSession, path)
    return stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trailing_buyers(stream: DataFrame, size: str = "14 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_end, asset_id, buys, buyers, net_usd) per sliding window, emitted when no late row can change it.

    Buyers are counted exactly, by two aggregations, one after the other: a row of state per (window, asset, actor), and
    then one per (window, asset). Every row of state is of fixed size, and an asset's buyers are spread by their names.
    """
    buys = stream.where("side = 'buy' AND asset_id IS NOT NULL").withWatermark("observed_at", late)
    of_actor = buys.groupBy(F.window("observed_at", size, step).alias("w"), "asset_id", "actor").agg(F.count(F.lit(1)).alias("n"), F.sum("usd_value").alias("usd"))
    found = of_actor.groupBy("w", "asset_id").agg(F.sum("n").alias("buys"), F.count("actor").alias("buyers"), F.sum("usd").alias("net_usd"))
    return found.select(F.col("w.end").alias("window_end"), "asset_id", "buys", "buyers", "net_usd")


def watch(path: str, addresses: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the events of watched actors in ``path``, a folder per batch.

    ``addresses`` holds the lists, a folder ``version=N`` each (column ``actor``). A batch joins the newest list that is
    finished when it begins, and writes down which one; one that runs again takes the same, so it writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = _numbers(spark, f"{path}/used", f"{batch_id}")
        version = used[-1] if used else _numbers(spark, addresses, "version")[-1]
        if not used:
            spark.range(1).write.mode("overwrite").parquet(f"{path}/used/{batch_id}={version}")
        known = spark.read.schema("actor string").parquet(f"{addresses}/version={version}")
        scans.watched(batch, known).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


SIGNAL = "family string, asset_id string, wallet string, us bigint, significance double, risk_band string, dedupe_key string"
LIST_ORDER = ["significance", "us", "family", "asset_id", "wallet"]


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a key in a batch, in the order in which a run decides: the most significant first."""
    frame = pd.concat(list(rows))
    return frame.sort_values(LIST_ORDER, ascending=[False, True, True, True, True], kind="stable", na_position="first")


class SubjectPolicy(StatefulProcessor):
    """What the policy says of a signal for its subject (family, asset, wallet): duplicates, threshold, cooldown, muted families.

    The state of a subject maps the keys of the signals that were kept to their times. Those older than ``history``
    before the newest, which no rule looks at, go. With ``expire``, the state of a subject that stays silent for
    that long goes as well.
    """

    def __init__(self, config: AlertConfig = AlertConfig(), history_days: int = 7, expire: bool = False):
        self.config, self.history, self.expire = config, int(history_days * 24 * HOUR), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "dedupe_key string", "us bigint", int(self.history / 1000) if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        known, out = {k[0]: v[0] for k, v in self.kept.iterator()}, []
        frame = _in_order(rows)
        cooldown = int(self.config.cooldown_hours * HOUR)
        for r in frame.itertuples():
            critical = r.risk_band == "critical"
            if r.dedupe_key in known:
                decision = "duplicate"
            elif r.significance < self.config.threshold and not critical:
                decision = "threshold"
            elif not critical and any(0 <= r.us - us <= cooldown for us in known.values()):
                decision = "cooldown"
            else:
                known[r.dedupe_key] = int(r.us)
                self.kept.updateValue((r.dedupe_key,), (int(r.us),))
                decision = "muted" if r.family in MUTED_FAMILIES and not critical else "open"
            out.append(decision)
        newest = max(known.values(), default=0)
        for k in [k for k, us in known.items() if us < newest - self.history]:
            self.kept.removeKey((k,))
        yield frame.assign(decision=out)[[*frame.columns[: len(SIGNAL.split(","))], "decision"]]

    def close(self) -> None:
        pass


class DayPolicy(StatefulProcessor):
    """The last word on signals that no rule of their subject holds back: the day's cap, shadow mode, quiet hours. The state of a day is a count."""

    def __init__(self, config: AlertConfig = AlertConfig()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        told, out = (self.told.get()[0] if self.told.exists() else 0), []
        frame = _in_order(rows)
        for r in frame.itertuples():
            decision, critical = r.decision, r.risk_band == "critical"
            if decision == "open":
                if not critical and told >= self.config.max_per_day:
                    decision = "daily_cap"
                elif self.config.shadow:
                    decision = "shadow"
                elif r.quiet and not critical:
                    decision = "quiet"
                else:
                    decision, told = "delivered", told + 1
            out.append(decision)
        self.told.update((told,))
        yield frame.assign(decision=out)[[*frame.columns[: len(SIGNAL.split(","))], "decision"]]

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, config: AlertConfig = AlertConfig(), expire: bool = False) -> DataFrame:
    """A stream of signals (family, asset_id, wallet, triggered_at, significance, risks) with the decision of the whole alert policy.

    Two keyed states, one after the other: per subject, then per day. A batch reads the state of its own keys, whatever
    came before; its signals are decided in the order of a run. A stream has no runs, so ``max_per_run`` does not
    apply. Needs the RocksDB state store. With ``expire``, silent subjects' state goes; that is for streams that run on,
    as such a query never runs out of batches under the availableNow trigger.
    """
    at = F.col("triggered_at")
    signals = stream.select(
        "family", "asset_id", "wallet", F.unix_micros(at).alias("us"), "significance", fn.risk_band(F.col("family"), F.col("risks")).alias("risk_band"), fn.dedupe_key(F.col("family"), F.col("asset_id"), F.col("wallet"), at).alias("dedupe_key"),
        F.concat_ws(":", "family", F.coalesce("asset_id", F.lit("")), F.coalesce("wallet", F.lit(""))).alias("subject"),
    )
    mode = "processingTime" if expire else "None"
    by_subject = signals.groupBy("subject").transformWithStateInPandas(SubjectPolicy(config, expire=expire), outputStructType=f"{SIGNAL}, decision string", outputMode="append", timeMode=mode)
    quiet = fn.in_quiet_hours(F.timestamp_micros("us"), config.quiet_from, config.quiet_to).alias("quiet")
    dated = by_subject.select("*", quiet, F.to_date(F.timestamp_micros("us")).cast("string").alias("day"))
    return dated.groupBy("day").transformWithStateInPandas(DayPolicy(config), outputStructType=f"{SIGNAL}, decision string", outputMode="append", timeMode=mode)


HISTORY = "family string, asset_id string, wallet string, triggered_at timestamp, delivered boolean"


def alert_writer(path: str, config: AlertConfig = AlertConfig(), history_days: int = 7) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that decides on the signals of each batch by the whole alert policy, ``max_per_run`` too.

    Decisions go to a folder per batch. Beside them a batch leaves what the next ones have to look at: the kept signals
    of the last ``history_days``, so a batch reads one folder of history, whatever came before it; signals that are
    later than that meet no history. A batch that runs
    again reads the same folder and decides the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _numbers(spark, path, "history") if n < batch_id]
        history = spark.read.schema(HISTORY).parquet(f"{path}/history={earlier[-1]}") if earlier else spark.createDataFrame([], HISTORY)
        decided = policy.dispatch(batch, history, config).withColumn("delivered", F.col("decision") == "delivered")
        decided.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        stored = spark.read.schema(f"{HISTORY}, decision string").parquet(f"{path}/batch={batch_id}")
        kept = history.unionByName(stored.where(~F.col("decision").isin("duplicate", "threshold", "cooldown")).drop("decision"))
        newest = kept.agg(F.max(F.unix_micros("triggered_at"))).first()[0] or 0
        kept.where(F.unix_micros("triggered_at") >= newest - history_days * 24 * HOUR).coalesce(1).write.mode("overwrite").parquet(f"{path}/history={batch_id}")
        for n in earlier[:-1]:  # the last one stays for a batch that runs again
            tables.delete(spark, f"{path}/history={n}")

    return write


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions that ``alert_writer`` has made."""
    return written(spark, path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that a writer has put into ``path``."""
    return spark.read.parquet(*[f"{path}/batch={n}" for n in _numbers(spark, path, "batch")])
