"""Column expressions: keys, addresses, amounts, rates and texts. All of them stay inside Spark's code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.schema import CRITICAL_FAMILIES, DAY, HOUR

EVM, BASE58 = "^0x[0-9a-fA-F]{40}$", "^[1-9A-HJ-NP-Za-km-z]{32,44}$"


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def event_key(network, transaction_id, event_type, event_index, semantic_index=0) -> Column:
    """A stable key of an event; negative indexes are refused."""
    parts = [lit_or_col(p).cast("string") for p in (network, transaction_id, event_type, event_index, semantic_index)]
    key = F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32))
    bad = (lit_or_col(event_index) < 0) | (lit_or_col(semantic_index) < 0)
    return F.when(bad, F.raise_error(F.lit("negative event index"))).otherwise(key)


def is_valid_address(address: Column, network: Column) -> Column:
    """Hexadecimal for bsc and hyperliquid, base 58 for solana; other networks have no valid address."""
    trimmed = F.trim(address)
    return F.coalesce(F.when(network.isin("bsc", "hyperliquid"), trimmed.rlike(EVM)).when(network == "solana", trimmed.rlike(BASE58)), F.lit(False))


def normalize_address(address: Column, network: Column) -> Column:
    """Trimmed, and in lower case unless case matters; null if invalid."""
    trimmed = F.trim(address)
    return F.when(is_valid_address(address, network), F.when(network == "solana", trimmed).otherwise(F.lower(trimmed)))


def display_address(address: Column, keep: int = 4) -> Column:
    return F.when(F.length(address) > 2 * keep + 3, F.concat(F.left(address, F.lit(keep)), F.lit("…"), F.right(address, F.lit(keep)))).otherwise(address)


def parse_utc(text: Column) -> Column:
    """Timestamps that carry an offset; others are null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def to_decimal(text: Column) -> Column:
    return text.try_cast("decimal(38,18)")


def scale_amount(raw: Column, decimals: Column) -> Column:
    """Whole token units as a double, from atomic units; null outside 0..36 decimals."""
    return F.when(decimals.between(0, 36), raw.cast("double") / F.pow(F.lit(10.0), decimals))


def scaled_text(raw: Column, decimals: Column) -> Column:
    """Whole token units as text with every digit, from atomic units as decimal(38,0); null outside 0..36 decimals."""
    digits = F.lpad(F.abs(raw).cast("string"), 40, "0")
    whole = F.regexp_replace(F.substring(digits, F.lit(1), 40 - decimals), "^0+(?=.)", "")
    part = F.when(decimals > 0, F.concat(F.lit("."), F.substring(digits, 41 - decimals, decimals))).otherwise("")
    return F.when(decimals.between(0, 36), F.concat(F.when(raw < 0, "-").otherwise(""), whole, part))


def unscale_amount(amount: Column, decimals: Column) -> Column:
    return F.when(decimals.between(0, 36), F.bround(amount * F.pow(F.lit(10.0), decimals)).cast("decimal(38,0)"))


def add_amounts(a: Column, a_decimals: Column, b: Column, b_decimals: Column) -> Column:
    """Sum of atomic amounts; amounts of different decimals are refused."""
    return F.when(a_decimals == b_decimals, a + b).otherwise(F.raise_error(F.lit("amounts of different decimals")))


def is_acquisition(event_type: Column, side: Column) -> Column:
    bought = (event_type == "swap") & (side == "buy")
    opened = event_type.isin("position_opened", "position_increased") & (side == "long")
    return F.coalesce(bought | opened, F.lit(False))


def acquired_for_metrics(event_type: Column, side: Column) -> Column:
    """Swap purchases, and opened or increased positions on any side."""
    return F.coalesce((event_type == "swap") & (side == "buy"), F.lit(False)) | event_type.isin("position_opened", "position_increased")


def acquired_any(side: Column) -> Column:
    """Purchases and longs of any event type, resting orders included."""
    return F.coalesce(side.isin("buy", "long"), F.lit(False))


def bought(side: Column) -> Column:
    return F.coalesce(side == "buy", F.lit(False))


def is_intent_only(event_type: Column) -> Column:
    return event_type.isin("order_placed", "order_cancelled")


def is_resting(event_type: Column, filled: Column) -> Column:
    return (event_type == "order_placed") & ~F.coalesce(filled, F.lit(False))


def asset_id(network, address) -> Column:
    return F.concat_ws(":", lit_or_col(network), lit_or_col(address))


def asset_address(asset: Column) -> Column:
    return F.split_part(asset, F.lit(":"), F.lit(2))


def shrink(hits: Column, trials: Column, base: Column, prior: float = 8.0) -> Column:
    """Hit rate pulled towards the base rate by ``prior`` pseudo-trials; the base rate itself without trials."""
    return F.when(trials > 0, (hits + prior * base) / (trials + prior)).otherwise(base)


def wilson(hits: Column, trials: Column, z: float = 1.96) -> Column:
    """struct(lo, hi); (0, 1) without trials."""
    n = F.greatest(trials, F.lit(1)).cast("double")
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo, hi = (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)
    return F.struct(
        F.when(trials > 0, F.greatest(F.lit(0.0), lo)).otherwise(F.lit(0.0)).alias("lo"),
        F.when(trials > 0, F.least(F.lit(1.0), hi)).otherwise(F.lit(1.0)).alias("hi"),
    )


def months_between(first: Column, last: Column) -> Column:
    return F.greatest((micros(last) - micros(first)) / DAY, F.lit(1.0)) / 30.44


def days_between(first: Column, last: Column) -> Column:
    return (micros(last) - micros(first)) / DAY


def hours_between(first: Column, last: Column) -> Column:
    return (micros(last) - micros(first)) / HOUR


def outcome_id(outcome_class, asset: Column, t0: Column) -> Column:
    return F.concat_ws("_", F.lit("out"), lit_or_col(outcome_class), F.substring(asset_address(asset), 1, 10), F.unix_seconds(t0).cast("string"))


def dedupe_key(family: Column, asset: Column, wallet: Column, at: Column) -> Column:
    return F.concat_ws(":", family, F.coalesce(asset, F.lit("-")), F.coalesce(wallet, F.lit("-")), F.date_format(at, "yyyyMMdd"))


def defang(text: Column) -> Column:
    """Links that no client follows: http becomes hxxp, line breaks become blanks."""
    return F.trim(F.replace(F.replace(text, F.lit("http"), F.lit("hxxp")), F.lit("\n"), F.lit(" ")))


def in_quiet_hours(at: Column, start: int | None, end: int | None) -> Column:
    if start is None or end is None:
        return F.lit(False)
    hour = F.hour(at)
    return ((hour >= start) & (hour < end)) if start <= end else ((hour >= start) | (hour < end))


def risk_band(family: Column, risks: Column) -> Column:
    return F.when(family.isin(*CRITICAL_FAMILIES), "critical").when(F.size(risks) > 0, "elevated").otherwise("normal")


def lookback_bucket(delta_days: Column, windows: Sequence[int]) -> Column:
    out = F.lit(f"{max(windows)}d")
    for w in sorted(windows, reverse=True):
        out = F.when(delta_days <= w, f"{w}d").otherwise(out)
    return out


def stage_of(event_type: Column, side: Column, filled: Column, usd_value: Column, median_size: Column, probe_ratio: float = 0.15) -> Column:
    """Stage of a playbook that an event speaks for; null if none."""
    probe = (median_size > 0) & (F.coalesce(usd_value, F.lit(0.0)) < median_size * probe_ratio)
    return (
        F.when(is_resting(event_type, filled), "bidding")
        .when(event_type.isin("liquidation", "position_closed"), "aborted")
        .when(acquired_for_metrics(event_type, side), F.when(F.coalesce(probe, F.lit(False)), "probing").otherwise("accumulating"))
        .when((event_type == "swap") & (side == "sell"), "distributing")
    )


def significance(sizes: Column, usd_value: Column, event_type: Column, dormant_days: Column, trades_per_month: Column) -> Column:
    """struct(score, reasons): how unusual an action is for its own actor, whose sizes are given."""
    below = F.size(F.filter(sizes, lambda x: x <= usd_value)) / F.size(sizes)
    return significance_of(F.when(usd_value.isNotNull() & (F.size(sizes) > 0), below), event_type, dormant_days, trades_per_month)


def significance_of(share: Column, event_type: Column, dormant_days: Column, trades_per_month: Column) -> Column:
    """``significance`` where the share of the actor's sizes that are not above this one is known."""
    rare = event_type.isin("order_placed", "position_opened", "liquidation")
    score = (
        F.coalesce(0.35 * share, F.lit(0.0))
        + F.coalesce(0.30 * F.least(dormant_days / 60.0, F.lit(1.0)), F.lit(0.0))
        + F.when(rare, 0.20).otherwise(0.0)
        + F.when(trades_per_month <= 6, 0.15).otherwise(0.0)
    )
    # fixed values: the wording of the reasons, which stored signals carry
    reasons = F.array_compact(
        F.array(
            F.when(share >= 0.8, F.format_string("size in top %d%% of this wallet's history", (F.floor((1 - share) * 100) + 1).cast("int"))),
            F.when(dormant_days >= 21, F.format_string("first action in %d days", F.bround(dormant_days).cast("int"))),
            F.when(event_type == "order_placed", "placed a resting order below market").when(event_type == "position_opened", "opened a leveraged position").when(event_type == "liquidation", "was liquidated"),
            F.when(trades_per_month <= 6, F.format_string("wallet acts rarely (%.1f/month)", trades_per_month)),
        )
    )
    return F.struct(F.least(score, F.lit(1.0)).alias("score"), reasons.alias("reasons"))


def edge_confidence(observations: Column, consistency: Column) -> Column:
    return F.least(F.lit(0.85), 0.3 + 0.1 * observations) * F.greatest(consistency, F.lit(0.5))
