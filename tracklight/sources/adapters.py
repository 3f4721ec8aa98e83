"""Canonical events and candles from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clickstream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of the ``events`` table: users act on the assets named by props.k."""
    kind = F.col("event_type")
    to_type = F.when(kind.isin("purchase", "click"), "swap").when(kind == "view", "order_placed").when(kind == "signup", "position_opened").when(kind == "error", "liquidation").otherwise("unknown_interaction")
    side = F.when(kind == "purchase", "buy").when(kind == "click", "sell").when(kind.isin("view", "signup"), "long")
    at = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        fn.event_key("clicks", F.col("event_id"), to_type, F.lit(0)).alias("event_id"),
        to_type.alias("event_type"),
        at.alias("chain_time"),
        at.alias("observed_at"),
        F.lit("finalized").alias("finality"),
        F.col("user_id").cast("string").alias("actor"),
        F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("asset_id"),
        side.alias("side"),
        F.col("value").alias("usd_value"),
        F.col("value").alias("price_usd"),
        (kind != "view").alias("filled"),
    )


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of lineitem and orders: customers trade parts; returns are sells."""
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    at = F.col("l_shipdate").cast("timestamp")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        fn.event_key("market", F.col("l_orderkey"), F.lit("swap"), F.col("l_linenumber"), F.col("l_partkey")).alias("event_id"),
        F.lit("swap").alias("event_type"),
        at.alias("chain_time"),
        at.alias("observed_at"),
        F.lit("finalized").alias("finality"),
        F.col("o_custkey").cast("string").alias("actor"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("asset_id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_extendedprice").alias("usd_value"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"),
        F.lit(True).alias("filled"),
    )


def clickstream_candles(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """(asset_id, start, close, volume): per k and ``hours``: the median value, and the sum of values."""
    events = read(spark, sf_dir, "events")
    step = hours * 3600
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / step) * step)
    asset = F.concat(F.lit("k:"), F.get_json_object("props", "$.k"))
    return events.groupBy(asset.alias("asset_id"), start.alias("start")).agg(F.median("value").alias("close"), F.sum("value").alias("volume"))


def market_candles(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """(asset_id, start, close, volume): per part and ``days``: the median unit price, and the sum of prices."""
    step = days * 86400
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / step) * step)
    asset = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    return read(spark, sf_dir, "lineitem").groupBy(asset.alias("asset_id"), start.alias("start")).agg(
        F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("volume")
    )


def brand_candles(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    """As market_candles, per brand."""
    step = days * 86400
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / step) * step)
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.concat(F.lit("brand:"), "p_brand").alias("asset_id"), start.alias("start"))
        .agg(F.median(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("volume"))
    )


def assets_of(events: DataFrame) -> DataFrame:
    """(asset_id, first_seen_at): the assets that events name."""
    return events.where("asset_id IS NOT NULL").groupBy("asset_id").agg(F.min("chain_time").alias("first_seen_at"))


def clickstream_listings(events: DataFrame) -> DataFrame:
    """A stand-in listing feed: the first opened position of each asset."""
    first = events.where("event_type = 'position_opened' AND asset_id IS NOT NULL").groupBy("asset_id").agg(F.min("observed_at").alias("t0"))
    return first.select(
        fn.outcome_id("cex_listing", F.col("asset_id"), F.col("t0")).alias("outcome_id"),
        F.lit("cex_listing").alias("outcome_class"),
        "asset_id",
        "t0",
        F.col("t0").alias("first_observed_at"),
        F.lit(None).cast("double").alias("magnitude"),
        F.create_map(F.lit("source"), F.lit("first opened position")).alias("evidence"),
        F.lit("1").alias("definition_version"),
        F.lit("clickstream").alias("venue"),
    )
