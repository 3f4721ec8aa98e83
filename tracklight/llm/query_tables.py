"""Queries of the operators that keep totals and plans: token counts, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.llm import mixing, token_counts
from tracklight.llm.catalogue import query
from tracklight.llm.common import materialize, new_path, table


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.plan_copies(materialize(mixing.sized_documents(documents).drop("text"), "mix-documents"))
    return plan.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).cast("long").alias("taken"),
        F.col("_mix_rate").alias("rate"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
    coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')), 0) AS pieces,
    min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM documents
), live AS (SELECT * FROM d WHERE doc_id = first_id OR doc_id IS NULL OR text IS NULL)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(words)::BIGINT AS n_tokens FROM live GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1', count(*)::BIGINT, sum(pieces)::BIGINT FROM live GROUP BY ALL
"""


@query("op2_token_counts", OP2_SQL)
def op2_token_counts(spark, sf_dir):
    """Four batches, one of them delivered twice: all documents are inserted by their words, all are counted by
    pieces, a provisional count is revised, and later copies of a text are deleted, each by its id and text."""
    unset = {"old_tokens": F.lit(None).cast("long"), "old_tokenizer": F.lit(None).cast("string")}
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("digest"))
    counts = materialize(token_counts.count_documents(documents, also=("digest",)), "token-rows")
    digest = counts.where("tokenizer = 'words-1'").select("doc_id", "digest")
    first = digest.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(digest.join(first.drop("n"), "digest").where("doc_id > first_id").select("doc_id", "digest").distinct(), "token-copies")
    rollup = token_counts.Rollup(spark, new_path(spark, "token-rollup"))
    words = counts.where("tokenizer = 'words-1'")
    rollup.commit(words.withColumn("op", F.lit("insert")).withColumns(unset), 0)
    pieces = counts.where("tokenizer = 'pieces-1'").withColumn("op", F.lit("insert")).withColumns(unset)
    provisional = pieces.withColumns({"tokens": F.col("tokens") + 1, "tokenizer": F.lit("pieces-0")})
    rollup.commit(provisional, 1)
    revised = pieces.withColumns({"op": F.lit("revise"), "old_tokens": F.col("tokens") + 1, "old_tokenizer": F.lit("pieces-0")})
    rollup.commit(revised, 2)
    rollup.commit(revised, 2)
    gone = counts.join(copies, ["doc_id", "digest"], "left_semi").withColumn("op", F.lit("delete")).withColumns(unset)
    rollup.snapshot()
    rollup.commit(gone, 3)
    return rollup.read()

