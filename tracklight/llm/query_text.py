"""Queries over texts and vectors: SentencePiece encoding, exact search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.llm import exact_search, sentencepieces
from tracklight.llm.catalogue import query
from tracklight.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(documents, piece_model_path(), digests=True)


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND NOT list_contains([coalesce(isfinite(x), false) for x in embedding], false)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, least(len(q.v), len(c.v)) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op7_exact_topk", OP7_SQL)
def op7_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", exact_search.quantise(F.col("embedding")).alias("v"))
    return exact_search.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
