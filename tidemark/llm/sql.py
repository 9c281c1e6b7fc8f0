"""Reference SQL (DuckDB dialect) of the queries that SQL can express."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h1,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h2
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sources),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
shared AS (SELECT min_by(level, most / weight) AS level FROM leveled WHERE NOT most <= weight * level),
targets AS (
  SELECT source, source_size,
    CASE WHEN most <= weight * leveled.level THEN most ELSE weight * (SELECT level FROM shared) END AS target
  FROM leveled),
queued AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h1, h2, n) AS upto FROM (
    SELECT s.*, t.source_size, t.target, row_number() OVER (PARTITION BY s.source, h1, h2) AS n
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)),
finished AS (
  SELECT source, pass, h1, h2, n, size, (pass * source_size + upto)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1]) AS pass)
  WHERE target > 0 AND size > 0 AND (pass * source_size + upto - size)::DOUBLE / target < 1),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, h1, h2, n) AS through FROM finished),
copies AS (
  SELECT source, h1, h2, n, count(DISTINCT pass) AS copies FROM summed
  WHERE through <= 1.5::DOUBLE * (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(c.copies, 0))::BIGINT AS taken
FROM queued q LEFT JOIN copies c ON q.source IS NOT DISTINCT FROM c.source AND q.h1 = c.h1 AND q.h2 = c.h2 AND q.n = c.n
"""

NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM usable UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component_id, e.vec_id)::BIGINT AS component_id,
  coalesce(e.vec_id = coalesce(l.component_id, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""

JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(min(texts.doc_id) OVER (PARTITION BY t) < texts.doc_id, false)::INT AS mask
  FROM texts LEFT JOIN marks ON marks.doc_id = texts.doc_id),
masks AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letters v JOIN letters w ON w.l <> v.l JOIN letters x ON x.l NOT IN (v.l, w.l)
  JOIN letters y ON y.l NOT IN (v.l, w.l, x.l) JOIN letters z ON z.l NOT IN (v.l, w.l, x.l, y.l)),
steps AS (
  SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, b,
    sum(CASE WHEN mask & (before | b) = 0 THEN docs ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN docs ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN docs ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = b THEN docs ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM counted
"""
