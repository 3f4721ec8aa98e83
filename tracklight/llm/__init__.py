"""Operators for preparing training data: filtering, deduplication, mixing, encoding and search."""
