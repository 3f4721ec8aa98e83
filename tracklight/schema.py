"""Table schemas and configuration of the analytics. Every threshold is a parameter with the usual default."""

from __future__ import annotations

from dataclasses import dataclass

#: Column types of the canonical event table (ingestion edge; analytics read values as doubles).
EVENTS = (
    "event_id string, schema_version int, event_type string, network string, block_height bigint, event_index int, "
    "transaction_id string, chain_time timestamp, observed_at timestamp, finality string, actor string, asset_id string, "
    "counterparty string, side string, usd_value decimal(38,8), price_usd decimal(38,18), limit_price_usd decimal(38,18), "
    "leverage decimal(12,4), filled boolean, provider string, parser_version string, quality_flags array<string>, extra map<string,string>"
)

# Names that stored tables and users share.
EVENT_TYPES = (
    "transfer", "swap", "token_created", "pool_created", "liquidity_added", "liquidity_removed", "authority_changed", "position_opened",
    "position_increased", "position_reduced", "position_closed", "order_placed", "order_cancelled", "liquidation", "unknown_interaction",
)
FINALITIES = ("pending", "confirmed", "finalized", "reverted")
NETWORKS = ("solana", "bsc", "hyperliquid")
PREDICTIVE = ("price_run", "cex_listing", "revival")
OUTCOME_CLASSES = (*PREDICTIVE, "rug_or_collapse", "pump_event")
STAGES = ("dormant", "probing", "bidding", "accumulating", "confirming", "distributing")  # "aborted" has no place in it
MUTED_FAMILIES = ("silent_accumulation",)
CRITICAL_FAMILIES = ("pump_operator_activity",)

DAY = 86_400_000_000  # microseconds
HOUR = 3_600_000_000


@dataclass(frozen=True)
class OutcomeConfig:
    run_multiple: float = 3.0
    run_baseline_days: float = 7
    run_least_volume: float = 500.0
    run_least_candles: int = 10
    run_least_baseline: int = 4
    dormant_days: float = 45
    dormant_gap_days: float = 32
    dormant_most_volume: float = 500.0
    dormant_least_candles: int = 20
    dormant_least_baseline: int = 8
    wake_multiple: float = 4.0
    wake_days: float = 14
    drawdown: float = 0.85
    collapse_least_candles: int = 10
    pump_gap_days: float = 14
    confirmation_hours: float = 6
    definition_version: str = "1"


DAILY_OUTCOMES = OutcomeConfig(run_least_volume=25_000.0, dormant_most_volume=10_000.0)


@dataclass(frozen=True)
class WalletConfig:
    prior: float = 8.0
    most_trades_per_month: float = 45.0
    most_tokens_per_month: float = 25.0
    sniper_seconds: float = 30.0
    sniper_entries: int = 3
    active_hours: int = 20
    active_actions: int = 50
    quiet_trades_per_month: float = 6.0
    quiet_shrunk: float = 0.30
    quiet_edge: float = 2.0
    least_tokens: int = 5
    listing_rate: float = 0.5
    revival_rate: float = 0.5
    collapse_share: float = 0.6


@dataclass(frozen=True)
class DiscoveryConfig:
    lookback_days: tuple = (1, 7, 30)
    min_events: int = 4
    min_independent: int = 3
    min_edge: float = 1.8
    min_shrunk: float = 0.20
    independence_days: float = 21
    shadow_days: float = 30
    near_misses: int = 25


@dataclass(frozen=True)
class GraphConfig:
    max_lag_days: float = 21
    min_shared: int = 3
    lead_consistency: float = 0.75
    evidence_assets: int = 20


@dataclass(frozen=True)
class PlaybookConfig:
    probe_ratio: float = 0.15
    window_days: float = 45
    min_sequences: int = 3


@dataclass(frozen=True)
class SignalConfig:
    lookback_days: float = 3
    silent_days: float = 14
    silent_buyers: int = 3
    silent_move: float = 0.25
    convergence_days: float = 5
    convergence_wallets: int = 2
    min_significance: float = 0.25
    sequence_days: float = 14


@dataclass(frozen=True)
class AlertConfig:
    threshold: float = 0.35
    cooldown_hours: float = 6
    max_per_run: int = 25
    max_per_day: int = 6
    shadow: bool = False
    quiet_from: int | None = None
    quiet_to: int | None = None


@dataclass(frozen=True)
class BacktestConfig:
    delay_seconds: int = 300
    fee_bps: float = 30.0
    slippage_bps: float = 150.0
    size_usd: float = 1000.0
    hold_days: float = 14
    max_staleness_days: float | None = None


# The wording of signals, which stored signals carry. "%s" and the like are filled per signal.
SIGNAL_TEXTS = {
    "action_title": "%s wallet %s… %s %s",
    "action_resting": "placed a resting order on",
    "action_other": "acted on",
    "action_risk": "Order is unfilled — this is stated intent, not a position",
    "action_unknown": "Wallet ownership is inferred from behaviour, not established",
    "silent_title": "Quiet accumulation in %s — %d buyers, price flat",
    "silent_buyers": "%d distinct buyers over {days:g} days",
    "silent_volume": "$%s accumulated with no material price move",
    "silent_risk": "Flat price may reflect illiquidity rather than absorption",
    "silent_unknown": "Buyer independence not yet verified",
    "convergence_title": "%d independent tracked wallets converged on %s",
    "convergence_fact": "%d of %d participating wallets have no detected relationship to each other",
    "convergence_risk": "Undetected relationships would reduce this to a single opinion",
    "convergence_unknown": "Clustering is heuristic; absence of an edge is not proof",
    "sequence_title": "Side wallet %s… confirmed %s… on %s",
    "sequence_lag": "follower acted %.1fh after leader; historical median %.1fh",
    "sequence_order": "ordering held in %.0f%% of %d shared assets",
    "sequence_risk": "Consistent lag can reflect public copy-trading, not coordination",
    "operator_title": "Known pump operator %s… entered %s",
    "operator_episodes": "%d prior episodes observed",
    "operator_hours": "median time from entry to distribution: %.0fh",
    "operator_collapsed": "%d of %d prior assets subsequently collapsed",
    "operator_exit": "Exit timing depends on beating participants who know the schedule",
    "operator_past": "Prior assets from this operator collapsed after distribution",
    "operator_unknown": "Operator may vary timing precisely to punish followers",
    "candidate_title": "New candidate wallet %s… (%s)",
    "candidate_independent": "%d independent outcome appearances",
    "candidate_rates": "shrunk hit rate %.1f%% vs base rate %.1f%%",
    "candidate_edge": "edge ratio %.1fx",
    "candidate_risk": "Not yet shadow-tested; retrospective evidence only",
    "candidate_unknown": "Forward performance unknown until the shadow period completes",
    "no_facts": "No supporting facts recorded",
}
