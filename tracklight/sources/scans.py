"""Scans of stored event, candle and listing tables. Filters are plain predicates, so that Spark pushes them down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observed_events(events: DataFrame, as_of: Column | None = None, since: Column | None = None, actor: str | None = None, asset: str | None = None, include_reverted: bool = False) -> DataFrame:
    """Events as they could be known at ``as_of``: by the time they were observed, not the time they happened."""
    out = events if include_reverted else events.where("finality <> 'reverted'")
    if as_of is not None:
        out = out.where(F.col("observed_at") <= as_of)
    if since is not None:
        out = out.where(F.col("observed_at") >= since)
    if actor is not None:
        out = out.where(F.col("actor") == actor)
    return out if asset is None else out.where(F.col("asset_id") == asset)


def backfill(events: DataFrame, start: Column, end: Column, addresses: DataFrame | None = None) -> DataFrame:
    """Events observed from start to end, both included, of the given addresses (column ``actor``) if any."""
    out = events.where(F.col("observed_at").between(start, end))
    return out if addresses is None else watched(out, addresses)


def watched(events: DataFrame, addresses: DataFrame) -> DataFrame:
    """Events of watched actors; ``events`` may be a stream. Spark broadcasts the addresses if they are few."""
    return events.join(addresses.select("actor").distinct(), "actor", "left_semi")


def candle_range(candles: DataFrame, asset: str, start: Column, end: Column) -> DataFrame:
    return candles.where((F.col("asset_id") == asset) & F.col("start").between(start, end)).orderBy("start")


def listings_since(listings: DataFrame, since: Column) -> DataFrame:
    return listings.where(F.col("first_observed_at") >= since)


def history(transactions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Landed transactions of a stretch of chain time."""
    return transactions.where(F.col("chain_time").between(start, end))
