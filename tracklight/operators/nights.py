"""Nights with state: all that a night leaves is published at once, and the next night starts from it.

``path`` holds the tables' data, which nobody looks for, and a folder ``night=KEY`` per published night: its manifest,
with a row for every part of every table as of that night. Data is written first; the manifest, written elsewhere, is
then renamed into place, which is the only step that others can see. A night that fails, however late, leaves the state
of the night before; one that runs again finds its manifest and does nothing; of two that run at once, the rename lets
one through. That needs a file system whose rename fails where there is something already, as HDFS and local ones do;
on an object store, keep ``path`` on a table format or a store with conditional puts.

Tables are replaced or added to. Outcomes, graded signals, decisions, proposals and digests only ever grow: a night
writes its own rows, and its manifest lists the parts of those before. Candidates and pending signals are written anew.
"""

from __future__ import annotations

import json
import operator
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.functions import tables
from tracklight.operators import sweep
from tracklight.schema import AlertConfig, DiscoveryConfig, GraphConfig, OutcomeConfig, SignalConfig, WalletConfig

MANIFEST = "name string, place int, path string, columns string"
SIGNALS = "signal_id string, family string, asset_id string, wallet string, triggered_at timestamp, significance double, title string, supporting_facts array<string>, evidence_ids array<string>, grade string, outcome_id string, lead_time_days double, delivered boolean"


class Nights:
    """The published nights in ``path``, which driver and executors can both reach. Keys are in the order of time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def keys(self) -> list[str]:
        at = self._hadoop.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n.removeprefix("night=") for n in names if n.startswith("night="))

    def manifest(self, key: str) -> list:
        """The parts (name, place, path, columns) of a night's tables: a row per table, and per night for those that grow."""
        return sorted(self.spark.read.schema(MANIFEST).json(f"{self.path}/night={key}").collect(), key=lambda r: (r["name"], r["place"]))

    def read(self, name: str, key: str) -> DataFrame | None:
        """A table as the night ``key`` left it; None if it has none of that name."""
        parts = [r for r in self.manifest(key) if r["name"] == name]
        if not parts:
            return None
        return self.spark.read.schema(T.StructType.fromJson(json.loads(parts[0]["columns"]))).parquet(*[r["path"] for r in parts])

    def publish(self, key: str, replaced: dict[str, DataFrame], added: dict[str, DataFrame]) -> bool:
        """Make the tables of a night visible together. False, and nothing is left, if that night is published already."""
        known = self.keys()
        if key in known:
            return False
        if known and key < known[-1]:
            raise ValueError(f"night {key} comes after {known[-1]}, which is published")
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = [tuple(r) for r in (self.manifest(known[-1]) if known else []) if r["name"] not in replaced]
        for name, df in (replaced | added).items():
            df.write.parquet(f"{data}/{name}")
            rows.append((name, sum(r[0] == name for r in rows), f"{data}/{name}", df.schema.json()))
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(draft)
        context = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._hadoop.Path(draft), self._hadoop.Path(f"{self.path}/night={key}"), self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
        except Py4JJavaError:
            for left in (draft, data):
                tables.delete(self.spark, left)
            if key in self.keys():
                return False
            raise
        return True


def signals_of(found: DataFrame) -> DataFrame:
    """``found`` as stored signals (``SIGNALS``); columns that it lacks are null, and a signal without a grade is pending."""
    blank = found.sparkSession.createDataFrame([], SIGNALS)
    rows = found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in blank.schema])
    return rows.withColumns({"grade": F.coalesce("grade", F.lit("pending")), "delivered": F.coalesce("delivered", F.lit(False))})


def run_night(
    nights: Nights, at: str, events: DataFrame, candles: DataFrame, assets: DataFrame, listed: DataFrame | None = None, stored: DataFrame | None = None, blank: str = sweep.ds.CANDIDATES,
    detect: OutcomeConfig = OutcomeConfig(), discover: DiscoveryConfig = DiscoveryConfig(), wallets: WalletConfig = WalletConfig(), alert: AlertConfig = AlertConfig(), signal: SignalConfig = SignalConfig(), graph: GraphConfig = GraphConfig(),
) -> bool:
    """The night of the moment ``at``, from the state of the one before it. False, and no work, if it is published already.

    Candles and ``listed`` (outcomes of a listing feed) count as far as they were seen by then. ``stored`` are the
    signals (``signals_of``) that the first of all nights starts from.
    """
    key, as_of, spark = at.replace(" ", "T").replace(":", ""), F.lit(at).cast("timestamp"), nights.spark
    known = nights.keys()
    if key in known:
        return False
    last = known[-1] if known else None
    before = lambda name, empty: nights.read(name, last) if last else empty
    none = spark.createDataFrame([], SIGNALS)
    pending, graded = before("pending", signals_of(none if stored is None else stored)), before("graded", none)
    seen = candles.where(F.col("start") <= as_of)
    more = None if listed is None else listed.where(F.col("first_observed_at") <= as_of)
    known_outcomes = before("outcomes", None)
    if known_outcomes is None:
        known_outcomes = sweep.oc.detect_all(seen.limit(0), detect)
    candidates = before("candidates", spark.createDataFrame([], blank))
    with tables.scratch(spark):
        night = sweep.nightly(events, seen, assets, known_outcomes, candidates, pending.withColumn("_judged", F.lit(True)).unionByName(graded.withColumn("_judged", F.lit(False))), as_of, detect, discover, wallets, alert, signal, graph, listed=more)
        told = night.decisions.select("place", "decision", "dedupe_key", "family", "asset_id", "wallet", "triggered_at", "significance", "risk_band")
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("family", "asset_id", "wallet", "triggered_at", "significance")]
        kept = told.where(~F.col("decision").isin("duplicate", "threshold", "cooldown")).alias("d")
        named = night.signals.alias("s").join(F.broadcast(kept), reduce(operator.and_, same), "left_semi")  # max_per_run rows
        texts = named.groupBy("family", "asset_id", "wallet", "triggered_at", "significance").agg(*[F.min(c).alias(c) for c in ("title", "supporting_facts", "evidence_ids")]).alias("s")
        new = kept.join(texts, reduce(operator.and_, same), "left")
        new = new.select(F.concat_ws(":", F.lit(key), F.col("d.dedupe_key"), F.col("d.place")).alias("signal_id"), "d.family", "d.asset_id", "d.wallet", "d.triggered_at", "d.significance", "s.title", "s.supporting_facts", "s.evidence_ids", (F.col("d.decision") == "delivered").alias("delivered"))
        final = F.col("grade") != "pending"
        judged = night.graded.where("_judged")
        stamp = lambda df: df.withColumn("night", F.lit(key))
        return nights.publish(
            key,
            replaced={"candidates": night.candidates.drop("transition"), "pending": signals_of(judged.where(~final)).unionByName(signals_of(new))},
            added={"outcomes": night.outcomes, "graded": signals_of(judged.where(final)), "decisions": stamp(told), "proposals": stamp(night.proposals), "digest": stamp(night.digest)},
        )
