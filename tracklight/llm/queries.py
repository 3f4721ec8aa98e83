"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tracklight.llm import query_manifest, query_models, query_near, query_rules, query_runs, query_tables, query_text, query_urls
from tracklight.llm.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "query_manifest", "query_models", "query_near", "query_rules", "query_runs", "query_tables", "query_text", "query_urls"]
