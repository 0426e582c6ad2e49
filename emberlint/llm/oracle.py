"""SQL, in DuckDB's dialect, for results of queries whose methods are something else altogether."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS said
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM p) q),
f AS (SELECT s.doc_id, s.k, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND array_to_string(s.w[s.k : s.k + s.n - 1], ' ') = p.said),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM f)) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.said = y.said AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * n_both >= 75 * (u.n + v.n - n_both)),
c(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON m.id = d.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY said ORDER BY doc_id, k) AS place FROM s) WHERE place > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS place FROM r),
p AS (SELECT doc_id, w[place] AS word, place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM d)),
t AS (SELECT p.doc_id, count(g.place) AS n_removed, string_agg(CASE WHEN g.place IS NULL THEN p.word END, ' ' ORDER BY p.place) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
