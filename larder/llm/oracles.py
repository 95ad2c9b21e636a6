"""SQL for DuckDB of the operators that SQL can express on whole tables."""

SPLIT = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {SPLIT.format(text="coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM (SELECT h.doc_id, h.i FROM h JOIN m ON m.h = h.h WHERE h.doc_id > m.least) f),
k AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
t AS (SELECT k.doc_id, count(*) AS n, string_agg(k.word, ' ' ORDER BY k.j) AS kept FROM k ANTI JOIN g ON g.doc_id = k.doc_id AND g.j = k.j GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS bigint) AS n_words, CAST(len(ws) - coalesce(t.n, 0) AS bigint) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id"""

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= 80 * (x.n + y.n - p.both)),
r AS (SELECT doc_id, doc_id AS id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.id),
c AS (SELECT doc_id, min(id) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id"""

EMBEDDING_DEDUP = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.s > 0 AND b.s > 0 WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.9),
r AS (SELECT vec_id, vec_id AS id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.id),
c AS (SELECT vec_id, min(id) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.vec_id = e.vec_id"""

HARD_NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS double[]), lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS bigint) AS score FROM e a JOIN e b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS int) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) QUALIFY row_number() OVER w <= 3"""

RANKED_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {RANKED_TERMS} AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS bigint) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS bigint) AS total FROM n),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) x GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS bigint) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term) f, c),
q AS (SELECT row_number() OVER () AS q, item_id, {RANKED_TERMS} AS ts FROM benchmark),
u AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(ts) AS term FROM q) x GROUP BY q, item_id, term),
s AS (SELECT u.q, u.item_id, n.r, n.doc_id, CAST(sum(u.c * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * docs) // total)))) AS bigint) AS score
  FROM u JOIN t ON t.term = u.term JOIN w ON w.term = u.term JOIN n ON n.r = t.r, c GROUP BY u.q, u.item_id, n.r, n.doc_id)
SELECT item_id, CAST(row_number() OVER v AS int) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW v AS (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER v <= 20"""
