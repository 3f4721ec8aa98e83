"""Collects every query module of the library proper."""

from __future__ import annotations

from tracklight.plans import q_graph, q_jobs, q_nights, q_outcomes, q_replay, q_signals, q_sources, q_views, q_wallets
from tracklight.plans.catalogue import ORACLE, QUERIES

MODULES = (q_outcomes, q_wallets, q_graph, q_signals, q_sources, q_jobs, q_nights, q_replay, q_views)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)


def flagship(spark, sf_dir):
    return QUERIES["appearance_counts"](spark, sf_dir)
