"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_REACH = """
reach AS (
  SELECT id, id AS seen FROM nodes
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.seen
),
component AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
"""

SQL = {
    "op3_exact_top_k": """
WITH whole AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM words
),
classes AS (SELECT s, min(doc_id) AS id, count(*) AS copies, len(s) AS n FROM sets WHERE s IS NOT NULL GROUP BY s),
grams AS (SELECT id, n, unnest(s) AS g FROM classes),
links AS (
  SELECT x.id AS a, y.id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.id <> y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING count(*) * 10 >= 8 * (x.n + y.n - count(*))
),
nodes AS (SELECT id FROM classes), {_REACH},
counted AS (SELECT a, sum(copies) AS others FROM links JOIN classes ON classes.id = links.b GROUP BY a)
SELECT d.doc_id, coalesce(c.id, d.doc_id) AS class_id,
  CAST(coalesce(c.copies - 1, 0) + coalesce(k.others, 0) AS BIGINT) AS n_links,
  coalesce(p.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(p.component_id, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN counted k ON k.a = c.id LEFT JOIN component p ON p.id = c.id
""",
    "op10_embedding_near_dedup": f"""
WITH RECURSIVE units AS (
  SELECT vec_id AS id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (SELECT x.id AS a, y.id AS b FROM units x JOIN units y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN component p ON p.id = e.vec_id
""",
    "op13_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
capped AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS full_at FROM sources),
filling AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST((SELECT sum(w) FROM sources) - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM capped WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
water AS (SELECT level FROM filling WHERE full_at > level ORDER BY full_at, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM water) * w, CAST(cap AS DOUBLE))) AS target FROM capped),
block AS (SELECT CAST(greatest(1, least(64, floor(min(target) / 256))) AS BIGINT) AS words FROM targets WHERE target > 0),
seats AS (SELECT CAST(floor(CAST(sum(size) AS DOUBLE) / (SELECT words FROM block) + 0.5) AS BIGINT) AS n FROM sized),
source_quotients AS (SELECT source, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place FROM targets, range((SELECT n FROM seats)) AS r(k) WHERE target > 0),
source_quotas AS (SELECT source, count(*) AS seats FROM source_quotients WHERE place <= (SELECT n FROM seats) GROUP BY source),
line AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS place FROM sized WHERE size > 0),
shards AS (
  SELECT source, place // 1048576 AS shard, CAST(sum(size) AS BIGINT) AS words, min(place) AS start FROM line GROUP BY ALL
),
shard_quotients AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS place, seats
  FROM (SELECT s.*, q.seats, unnest(range(q.seats)) AS k FROM shards s JOIN source_quotas q ON s.source IS NOT DISTINCT FROM q.source)
),
shard_quotas AS (SELECT source, shard, count(*) AS quota FROM shard_quotients WHERE place <= seats GROUP BY source, shard),
asked AS (SELECT s.*, (SELECT words FROM block) AS b, least(coalesce(q.quota, 0) * (SELECT words FROM block), 3 * s.words) AS chosen
  FROM shards s LEFT JOIN shard_quotas q ON s.source IS NOT DISTINCT FROM q.source AND s.shard = q.shard),
runs AS (SELECT *, chosen // words AS rounds, chosen % words AS rest, ((shard + 1) * 7919) % CAST(ceil(CAST(words AS DOUBLE) / b) AS BIGINT) * b AS first FROM asked),
spans AS (
  SELECT l.doc_id, l.size, l.source, r.rounds, r.words, l.place - r.start AS a, l.place - r.start + l.size AS z, r.first AS c, r.first + r.rest AS d
  FROM line l JOIN runs r ON l.source IS NOT DISTINCT FROM r.source AND l.place // 1048576 = r.shard
),
taken AS (
  SELECT doc_id, source, size, rounds * size + greatest(0, least(z, d) - greatest(a, c)) + greatest(0, least(z, d - words) - a) AS taken FROM spans
  UNION ALL SELECT doc_id, source, size, 0 FROM sized WHERE size = 0
)
SELECT k.doc_id, k.size, t.source_size, t.target, CAST(k.taken AS BIGINT) AS taken FROM taken k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
""",
}
