"""Query of the dataset manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.llm import merkle
from tracklight.llm.catalogue import query
from tracklight.llm.common import materialize, table

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: crc32, bit by bit: a byte is mixed in, then eight shifts follow.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(FIELD.format(text if f == "text" else f) for f in FIELDS) + ")"


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_leaf_sql("text")} AS leaf,
    {_leaf_sql("replace(text, chr(10), '')")} AS bare, coalesce({CRC32_SQL} % 2 = 0, false) AS hit
  FROM documents
), placed AS (
  SELECT *, CASE WHEN hit THEN bare ELSE leaf END AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM d
), nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3, n
), tops AS (SELECT tree, digest AS subroot, level AS height FROM nodes WHERE n = 1),
trunk AS (
  SELECT 0 AS level, tree AS place, subroot AS digest, (SELECT count(*) FROM tops) AS n FROM tops
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM trunk WHERE n > 1 GROUP BY level, place // 3, n
), root AS (SELECT digest AS root FROM trunk WHERE n = 1),
every AS (
  SELECT tree, level, place, digest FROM nodes WHERE n > 1
  UNION ALL
  SELECT t.tree, t.height + u.level, u.place, u.digest FROM trunk u CROSS JOIN tops t WHERE u.n > 1
), spots AS (
  SELECT rid, p.tree, level, CASE WHEN level < height THEN p.place // (3 ** level)::BIGINT ELSE p.tree // (3 ** (level - height))::BIGINT END AS spot
  FROM placed p JOIN tops t ON t.tree = p.tree JOIN (SELECT DISTINCT tree, level FROM every) l ON l.tree = p.tree
), steps AS (
  SELECT rid, s.level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place < spot), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place > spot), '') AS after
  FROM spots s JOIN every e ON e.tree = s.tree AND e.level = s.level AND e.place // 3 = spot // 3 GROUP BY 1, 2
), fold AS (
  SELECT rid, 0 AS level, shown AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.level + 1, sha256(before || f.digest || after) FROM fold f JOIN steps s ON s.rid = f.rid AND s.level = f.level
), folded AS (SELECT rid, arg_max(digest, level) AS folded_root FROM fold GROUP BY 1),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN tops t ON t.tree = p.tree CROSS JOIN root JOIN folded f ON f.rid = p.rid LEFT JOIN proofs s ON s.rid = p.rid
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = merkle.row_digest(*[F.col(c) for c in FIELDS])
    bare = merkle.row_digest(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaves = documents.select("doc_id", "source", found.alias("leaf"), F.when(hit, bare).otherwise(found).alias("shown"))
    return merkle.manifest(materialize(leaves, "merkle-digests"), shown="shown").drop("source", "shown")
