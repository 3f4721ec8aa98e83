"""Query of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.llm import near_dedup
from tracklight.llm.catalogue import query
from tracklight.llm.common import table


@query("op5_order_minhash")
def op5_order_minhash(spark, sf_dir):
    classes = near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
