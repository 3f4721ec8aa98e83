"""Query of the url filter."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tracklight.llm import url_filter
from tracklight.llm.catalogue import query
from tracklight.llm.common import table

CONFIG = url_filter.UrlConfig()
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

TERMS = ", ".join(f"('{t}')" for t in CONFIG.terms)
UNKNOWN, LETTER = round(url_filter.UNIT * math.log(CONFIG.unknown)), round(-url_filter.UNIT * math.log(CONFIG.alphabet))

OP11_SQL = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), paths AS (SELECT *, regexp_extract_all(lower(path), '\p{{L}}+') AS found FROM parts),
shaped AS (SELECT page_id, host, path, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ' ') AS shape FROM paths),
hosts AS (SELECT DISTINCT host AS name FROM shaped), shapes AS (SELECT DISTINCT shape AS name FROM shaped),
names AS (SELECT 'host' AS kind, name FROM hosts UNION ALL SELECT 'path', name FROM shapes),
spots AS (SELECT kind, name, p[i] AS piece, i FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT kind, name, regexp_extract_all(lower(name), '\p{{L}}+') AS p FROM names))),
labels AS (SELECT l[i] AS label, i = len(l) AS last FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT string_split(name, '.') AS l FROM hosts))),
named AS (
  SELECT word, count(*) AS m FROM (
    SELECT unnest(p) AS word FROM (SELECT regexp_extract_all(lower(label), '\p{{L}}+') AS p, last FROM labels) WHERE len(p) > 1 OR last
    UNION ALL SELECT * FROM (VALUES {TERMS}) t(word)
  ) WHERE length(word) <= {CONFIG.longest_word} GROUP BY 1
), texted AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents) WHERE length(word) BETWEEN 1 AND {CONFIG.longest_word} GROUP BY 1
), words AS (
  SELECT word, round(1000000 * ln({CONFIG.text_share} * coalesce(n / (SELECT sum(n) FROM texted), 0) + {1 - CONFIG.text_share} * coalesce(m / (SELECT sum(m) FROM named), 0)))::BIGINT AS weight
  FROM texted FULL JOIN named USING (word)
), pieces AS (SELECT DISTINCT piece FROM spots),
spans AS (SELECT piece, s, unnest(range(1, least({CONFIG.longest_word}, length(piece) - s + 1) + 1)) AS l FROM (SELECT piece, unnest(range(1, length(piece) + 1)) AS s FROM pieces)),
edges AS (SELECT piece, s + l - 1 AS stop, list({{'weight': weight, 'l': l}}) AS e FROM spans JOIN words ON word = substring(piece, s, l) GROUP BY 1, 2),
steps AS (
  SELECT p.piece, p.i, coalesce(e, []) AS e FROM (SELECT piece, unnest(range(1, length(piece) + 1)) AS i FROM pieces) p LEFT JOIN edges x ON x.piece = p.piece AND x.stop = p.i
), walk AS (
  SELECT piece, 0 AS i, [0::BIGINT] AS best, [[]::VARCHAR[]] AS said, NULL::BIGINT AS open, 0::BIGINT AS run FROM pieces
  UNION ALL
  SELECT piece, i, list_append(best, pick.score), list_append(said, list_append(said[i + 1 - pick.l], substring(piece, (i + 1 - pick.l)::BIGINT, pick.l::BIGINT))), open, run
  FROM (
    SELECT piece, i, best, said, open, run, list_max(list_prepend({{'score': open, 'l': run}}, list_transform(e, lambda x: {{'score': best[i + 1 - x.l] + x.weight, 'l': x.l}}))) AS pick
    FROM (
      SELECT w.piece, s.i, best, said, e, CASE WHEN open IS NULL OR best[s.i] + {UNKNOWN} > open THEN best[s.i] + {UNKNOWN} ELSE open END + {LETTER} AS open,
        CASE WHEN open IS NULL OR best[s.i] + {UNKNOWN} > open THEN 1 ELSE run + 1 END AS run
      FROM walk w JOIN steps s ON s.piece = w.piece AND s.i = w.i + 1
    )
  )
), split AS (SELECT piece, said[length(piece) + 1] AS words FROM walk WHERE i = length(piece)),
spelled AS (SELECT kind, name, flatten(list(words ORDER BY i)) AS words FROM spots JOIN split USING (piece) GROUP BY 1, 2),
labelled AS (SELECT name AS host, list_has_any(regexp_extract_all(lower(name), '\p{{L}}+'), {list(CONFIG.terms)}) AS bad FROM hosts),
examples AS (
  SELECT 'host' AS kind, unnest(words) AS word, bad FROM spelled JOIN labelled ON host = name WHERE kind = 'host'
  UNION ALL
  SELECT 'path', word, bad FROM (SELECT DISTINCT host, unnest(words) AS word FROM (SELECT DISTINCT host, shape FROM shaped) JOIN spelled ON kind = 'path' AND name = shape) JOIN labelled USING (host)
), counts AS (SELECT kind, word, count(*) FILTER (WHERE bad) AS b, count(*) FILTER (WHERE NOT bad) AS g FROM examples GROUP BY 1, 2),
totals AS (SELECT kind, sum(b) AS bs, sum(g) AS gs, count(*) AS v FROM counts GROUP BY 1),
model AS (SELECT kind, word, round(1000000 * ln(((b + 1) / (bs + v)) / ((g + 1) / (gs + v))))::BIGINT AS odds FROM counts JOIN totals USING (kind)),
prior AS (SELECT round(1000000 * ln((count(*) FILTER (WHERE bad) + 1) / (count(*) FILTER (WHERE NOT bad) + 1)))::BIGINT AS prior FROM labelled),
summed AS (SELECT kind, name, sum(odds)::BIGINT AS odds FROM (SELECT kind, name, unnest(words) AS word FROM spelled) JOIN model USING (kind, word) GROUP BY 1, 2),
rules AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) t(verdict, rhost, rpath)),
ruled AS (
  SELECT page_id, host, path, shape, (SELECT min({{'a': -length(rhost || rpath), 'b': -length(rhost), 'verdict': verdict, 'rule': rhost || rpath}}) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS r
  FROM shaped
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN 1 / (1 + exp(-(prior + coalesce(h.odds, 0) + coalesce(p.odds, 0)) / 1000000)) > {CONFIG.threshold} THEN 'block' ELSE 'allow' END) AS verdict,
  round(1 / (1 + exp(-(prior + coalesce(h.odds, 0) + coalesce(p.odds, 0)) / 1000000)), 6) AS score, coalesce(array_to_string(w.words, ' '), '') AS host_words
FROM ruled CROSS JOIN prior LEFT JOIN summed h ON h.kind = 'host' AND h.name = host LEFT JOIN summed p ON p.kind = 'path' AND p.name = shape LEFT JOIN spelled w ON w.kind = 'host' AND w.name = host
"""


@query("op11_url_filter", OP11_SQL)
def op11_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages, documents = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "documents").select("text")
    return url_filter.judge(pages, documents, rules).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"), "host_words")
