"""DuckDB SQL that gives the rows of the queries where SQL can express them."""

from __future__ import annotations

_COMPONENTS = """
walk(node, root) AS (
  SELECT id, id FROM nodes UNION SELECT e.b, w.root FROM walk w JOIN edges e ON e.a = w.node
)"""

SUBSTRING_DEDUP = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM ranked WHERE r > 1 GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS g FROM d),
sets AS (SELECT list_sort(g) AS g, min(doc_id) AS id, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
x AS (SELECT id, n, unnest(g) AS t FROM sets),
pairs AS (SELECT p.id AS a, q.id AS b, count(*) AS n_both, any_value(p.n) AS na, any_value(q.n) AS nb FROM x p JOIN x q ON p.t = q.t AND p.id < q.id AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * n_both >= 85 * (na + nb - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT id FROM sets), {_COMPONENTS},
c AS (SELECT node, min(root) AS c FROM walk GROUP BY node)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, s.doc_id = coalesce(c.c, s.doc_id) AS kept
FROM s LEFT JOIN sets ON list_sort(s.g) = sets.g LEFT JOIN c ON c.node = sets.id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
edges AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND list_cosine_similarity(p.e, q.e) >= 0.9),
nodes AS (SELECT id FROM v), {_COMPONENTS},
c AS (SELECT node, min(root) AS c FROM walk GROUP BY node),
n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, vec_id = coalesce(c.c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT item_id, w, least(8, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN iw ON iw.k = dw.k AND iw.t = dw.t),
h AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + k))))) AS n FROM (SELECT DISTINCT doc_id, i, k FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, array_to_string(list(s ORDER BY s), ',') AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN items USING (doc_id)
"""
