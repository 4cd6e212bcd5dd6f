"""DuckDB statements for the operators that SQL expresses."""

SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

SQL["op4_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role = 'assistant' AS target,
    length(text) + length(regexp_replace(text, '[^\\\[\]<>]', '', 'g'))
      + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 18 + length(role) END AS n FROM c),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
    max(CASE WHEN target THEN turn END) OVER (PARTITION BY conv_id) AS last_target, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE target), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE target), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (WHERE target OR (turn = last_turn AND turn IS DISTINCT FROM last_target)), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

SQL["op1_topk"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, n, lines[n] AS line, len(regexp_extract_all(lines[n], '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM d)),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l),
w AS (SELECT a.doc_id, a.n AS f, min(b.n) AS t FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.words + 50 GROUP BY a.doc_id, a.n
  UNION SELECT a.doc_id, max(b.n) AS f, a.n AS t FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.upto - b.words <= a.upto - 50 GROUP BY a.doc_id, a.n),
s AS (SELECT w.*, row_number() OVER (PARTITION BY array_to_string(lines[f:t], chr(10)) ORDER BY w.doc_id, f) AS copy FROM w JOIN d USING (doc_id)),
gone AS (SELECT DISTINCT l.doc_id, l.n FROM s JOIN l ON l.doc_id = s.doc_id AND l.n BETWEEN s.f AND s.t WHERE s.copy > 1),
runs AS (SELECT doc_id, min(n) - 1 AS f, max(n) - 1 AS t FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM gone) GROUP BY doc_id, g),
told AS (SELECT doc_id, string_agg(f || '-' || t, ',' ORDER BY f) AS removed, sum(t - f + 1) AS n_removed FROM runs GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.n) AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.n = l.n WHERE gone.n IS NULL GROUP BY l.doc_id)
SELECT x.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(told.n_removed, 0) AS BIGINT) AS n_removed, coalesce(told.removed, '') AS removed,
  CAST(length(coalesce(kept.text, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL["op12_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM c GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
o AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM c JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS total FROM o GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
    1 + (1000000000 * (k.total + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN o USING (lang, source, term) LEFT JOIN s USING (lang, source)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
t AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr
  UNION ALL SELECT * FROM (SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM t) WHERE rank <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""

SQL["op13_lexical_search"] = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents, low WHERE text IS NOT NULL),
n AS (SELECT id, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark, low WHERE text IS NOT NULL) GROUP BY item_id, term),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
x AS (SELECT q.item_id, n.doc_id, n.id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * s.docs) // s.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (id), s GROUP BY q.item_id, n.doc_id, n.id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
