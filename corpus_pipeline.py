"""The corpus pipeline: documents go through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of ``documents``; other columns of ``docs`` are left out. Empty tables give empty tables, and rows that
share an id are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.functions import tables
from tracklight.llm import language_id, line_dedup, mixing, near_dedup, sentencepieces
from tracklight.llm.common import table
from tracklight.llm.query_text import piece_model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some certainty; lang becomes the predicted one where it was null.

    Null texts, and texts without a letter, are ``und`` and go, as do ambiguous ones. Without any known language all go.
    """
    model = language_id.fit(docs)
    found = language_id.predict(docs.select(*COLUMNS), model).where((F.col("lang_pred") != language_id.UND) & ~F.col("ambiguous"))
    return found.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stand elsewhere before; a document of nothing else goes.

    Empty and null texts stay as they are. Rows equal in id and text are one document, and each row stays.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = kept.where((F.col("removed_chunks") == 0) | (F.col("text") != ""))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id.

    Null texts are like nothing and stay; so do rows without an id, and all rows of the id that stays.
    """
    return near_dedup.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; some are not taken.

    Texts without words are taken once. A null source is a source of its own.
    """
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the end id, and the text that they decode to: doc_id, lang, source, n_tokens, ids, decoded.

    Null texts are encoded as empty ones.
    """
    return sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), piece_model_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL cannot express the stages: two of them train or sample, three hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read is deleted once the stage is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = tables.new_path(spark, f"stage-{name}")
        with tables.scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        tables.delete_at_exit(spark, path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            tables.delete(spark, before)
        before = path
    return docs
