"""Alert policy: which signals of a run are told to anyone, and why the others are not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn
from tracklight.schema import HOUR, MUTED_FAMILIES, SIGNAL_TEXTS, AlertConfig

DECISIONS = ("duplicate", "threshold", "cooldown", "muted", "daily_cap", "shadow", "quiet", "delivered")


def dispatch(signals: DataFrame, history: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """The run's signals (at most ``max_per_run``, the most significant) with place, dedupe_key, risk_band and decision.

    ``history`` holds persisted signals (family, asset_id, wallet, triggered_at, delivered). Decisions depend on
    those before them in the list: first within a subject (family, asset, wallet), then within a day. Both folds
    run over the rows of one run, which ``max_per_run`` bounds; history is only looked up.
    """
    order = [F.desc("significance"), "triggered_at", "family", "asset_id", "wallet"]
    top = signals.orderBy(*order).limit(config.max_per_run)
    top = top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # max_per_run rows
    key = lambda: fn.dedupe_key(F.col("family"), F.col("asset_id"), F.col("wallet"), F.col("triggered_at"))
    top = top.select("*", key().alias("dedupe_key"), fn.risk_band(F.col("family"), F.col("risks")).alias("risk_band"))
    subject = ["family", "_asset", "_wallet"]
    keyed = lambda df: df.select("*", F.coalesce("asset_id", F.lit("")).alias("_asset"), F.coalesce("wallet", F.lit("")).alias("_wallet"))
    top = keyed(top)
    past = keyed(history.select("family", "asset_id", "wallet", "triggered_at", "delivered").withColumn("_key", key()))
    seen = past.select(F.col("_key").alias("dedupe_key"), F.lit(True).alias("_dup")).distinct()
    before = past.select(*subject, F.unix_micros("triggered_at").alias("_past"))
    gap = F.unix_micros("triggered_at") - F.col("_past")
    recent = top.select("place", "triggered_at", *subject).join(before, subject).where((gap >= 0) & (gap <= int(config.cooldown_hours * HOUR))).select("place", F.lit(True).alias("_recent")).distinct()
    told = past.where("delivered").groupBy(F.to_date("triggered_at").alias("_day")).agg(F.count(F.lit(1)).alias("_told"))
    rows = top.join(seen, "dedupe_key", "left").join(recent, "place", "left").withColumn("_day", F.to_date("triggered_at")).join(told, "_day", "left")
    rows = rows.select(
        "place", "family", "asset_id", "wallet", "triggered_at", "significance", "dedupe_key", "risk_band", F.unix_micros("triggered_at").alias("_us"), F.date_format("_day", "yyyyMMdd").alias("_day"),
        F.coalesce("_dup", F.lit(False)).alias("_dup"), F.coalesce("_recent", F.lit(False)).alias("_recent"), F.coalesce("_told", F.lit(0)).alias("_told"), *subject[1:],
        fn.in_quiet_hours(F.col("triggered_at"), config.quiet_from, config.quiet_to).alias("_quiet"), F.col("family").isin(*MUTED_FAMILIES).alias("_muted"), F.lit(None).cast("string").alias("decision"),
    )
    cooldown = int(config.cooldown_hours * HOUR)

    def by_subject(group: pd.DataFrame) -> pd.DataFrame:
        keys, kept, out = set(), [], []
        group = group.sort_values("place")
        for r in group.itertuples():
            critical, us, dup, near = r.risk_band == "critical", r[group.columns.get_loc("_us") + 1], r[group.columns.get_loc("_dup") + 1], r[group.columns.get_loc("_recent") + 1]
            if dup or r.dedupe_key in keys:
                out.append("duplicate")
            elif r.significance < config.threshold and not critical:
                out.append("threshold")
            elif not critical and (near or any(0 <= us - k <= cooldown for k in kept)):
                out.append("cooldown")
            else:
                keys.add(r.dedupe_key)
                kept.append(us)
                out.append("muted" if r[group.columns.get_loc("_muted") + 1] and not critical else "open")
        return group.assign(decision=out)

    def by_day(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("place"), []
        told = int(group["_told"].max()) if len(group) else 0
        for decision, band, quiet in zip(group["decision"], group["risk_band"], group["_quiet"], strict=True):
            if decision == "open":
                if band != "critical" and told >= config.max_per_day:
                    decision = "daily_cap"
                elif config.shadow:
                    decision = "shadow"
                elif quiet and band != "critical":
                    decision = "quiet"
                else:
                    decision, told = "delivered", told + 1
            out.append(decision)
        return group.assign(decision=out)

    decided = rows.groupBy(*subject).applyInPandas(by_subject, rows.schema).groupBy("_day").applyInPandas(by_day, rows.schema)
    return decided.drop("_us", "_day", "_dup", "_recent", "_told", "_asset", "_wallet", "_quiet", "_muted")


def alert_text(signals: DataFrame) -> DataFrame:
    """Adds ``alert_title`` and ``alert_body``: the first three facts, with no live links."""
    body = F.array_join(F.slice("supporting_facts", 1, 3), " | ")
    return signals.select("*", fn.defang(F.col("title")).alias("alert_title"), fn.defang(F.when(body != "", body).otherwise(SIGNAL_TEXTS["no_facts"])).alias("alert_body"))


def dispatch_counts(decided: DataFrame) -> DataFrame:
    """One row: how many signals each decision fell on, how many are persisted, and how many carry a critical risk."""
    of = {f"n_{d}": F.count_if(F.col("decision") == d) for d in DECISIONS}
    kept = F.count_if(~F.col("decision").isin("duplicate", "threshold", "cooldown"))
    critical = F.count_if((F.col("risk_band") == "critical") & (F.col("decision") != "duplicate"))
    return decided.agg(*[c.alias(n) for n, c in of.items()], kept.alias("persisted"), critical.alias("risk_flagged"))
