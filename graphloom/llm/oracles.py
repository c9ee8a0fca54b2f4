"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 1) AS sh FROM w, unnest(generate_series(1, greatest(1, len(ws) - 1))) AS u(i) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, w.doc_id = m.low AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS low FROM r GROUP BY 1) m ON m.a = w.doc_id
"""

_WORDS = rf"regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(ws, k, k + 9) AS win FROM i, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS u(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, k, n, list_slice(ws, k, k + n - 1) AS win FROM d, sizes, unnest(generate_series(1, len(ws) - n + 1)) AS u(k)),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw ON dw.win = iw.win),
ht AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(k, k + n - 1)) AS u(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN ht ON ht.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

OP10 = """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT q.r, q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""

OP1 = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, {_WORDS} AS ws FROM documents),
bw AS MATERIALIZED (SELECT r, i, md5(b[i:i + 399]) AS m FROM t, unnest(generate_series(1, octet_length(b) - 399)) AS u(i)),
bi AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM bw WHERE m IN (SELECT m FROM bw GROUP BY m HAVING count(*) > 1)),
bg AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM bi),
bs AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM bg GROUP BY r, g),
bp AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS q FROM bs),
cut AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(CASE WHEN a > q + 1 THEN hex(b[q + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS kept FROM bp JOIN t USING (r) GROUP BY r),
ww AS MATERIALIZED (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS m FROM t, unnest(generate_series(1, len(ws) - 49)) AS u(i)),
wi AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM ww WHERE m IN (SELECT m FROM ww GROUP BY m HAVING count(*) > 1)),
wg AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM wi),
ws AS (SELECT r, min(i) AS a, max(i) + 49 AS z FROM wg GROUP BY r, g),
held AS (SELECT r, count(*) AS n_passages, sum(z - a + 1) AS n_words FROM ws GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE unhex(kept || CASE WHEN last < octet_length(b) THEN hex(b[last + 1:octet_length(b)]) ELSE '' END) END) AS kept_sha256, coalesce(n_passages, 0) AS n_passages, CAST(coalesce(n_words, 0) AS BIGINT) AS n_passage_words
FROM t LEFT JOIN cut USING (r) LEFT JOIN held USING (r)
"""

ORACLES = {"op1_suffix_dedup": OP1, "op6_near_dedup": OP6, "op7_decontaminate": OP7, "op10_topk": OP10}
