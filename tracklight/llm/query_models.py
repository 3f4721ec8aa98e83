"""Queries of the operators that train a classifier: toxicity, language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.llm import language_id, samples, toxicity
from tracklight.llm.catalogue import query
from tracklight.llm.common import table


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.flag(toxicity.score(documents, model).drop("text"), model)
    return scored.select(
        "doc_id",
        samples.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= model.config.threshold).cast("int").alias("predicted"),
        "flagged",
    )


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language_id.fit(documents)
    found = language_id.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
