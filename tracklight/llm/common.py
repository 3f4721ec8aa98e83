"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.functions.tables import materialize, new_path, shared_dir

__all__ = ["NOT_WORD", "WORD", "broadcast_if_small", "free_name", "let", "materialize", "n_words", "new_path", "shared_dir", "table", "words_of"]

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it.

    Catalyst inlines projections into lambda bodies, where they would run once per element; a lambda
    variable bound to a one-element array cannot be inlined.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise as it is, for a shuffled join.

    ``df`` should be materialized, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
