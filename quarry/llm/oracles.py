"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP4 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p
  FROM documents WHERE text IS NOT NULL
), nb AS (
  SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS q,
         length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS w
  FROM l WHERE trim(line) <> ''
), cum AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY q) AS c FROM nb
), whole AS (
  SELECT doc_id, list(line ORDER BY q) AS lines FROM nb GROUP BY doc_id
), spans AS (
  SELECT a.doc_id, a.q AS a, min(b.q) AS b FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.q >= a.q AND b.c - a.c + a.w >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.q) AS a, b.q AS b FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.q >= a.q AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.q
), runs AS (
  SELECT s.doc_id, a, b, array_to_string(list_slice(lines, a, b), chr(10)) AS run FROM spans s JOIN whole USING (doc_id)
), firsts AS (
  SELECT *, min((doc_id, a)) OVER (PARTITION BY run) AS f FROM runs
), gone AS (
  SELECT DISTINCT n.doc_id, n.p FROM firsts r JOIN nb n ON n.doc_id = r.doc_id AND n.q BETWEEN r.a AND r.b WHERE f <> (r.doc_id, r.a)
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL) AS text, count(g.p) AS removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(removed, 0)::BIGINT AS removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP5 = r"""
WITH w AS (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' '))) AS s FROM w WHERE len(w) >= 5
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id
), d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), ds AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(list_slice(w, j, j + 4), ' '))) AS s FROM d WHERE len(w) >= 5
), shared AS (
  SELECT doc_id, item_id, count(DISTINCT s) AS n_shared FROM ds JOIN i USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""

OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT *, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), own AS (
  SELECT lang, source, sum(n) AS total, count(*) AS kinds FROM f GROUP BY ALL
), everyone AS (
  SELECT lang, sum(total) AS total FROM own GROUP BY ALL
), each AS (
  SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL
), p AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 5)::HUGEINT) // (own.total + 5 * own.kinds) AS p,
         1 + (1000000000 * (each.n + 5)::HUGEINT) // (everyone.total + 5 * own.kinds) AS q
  FROM f JOIN own ON own.lang = f.lang AND own.source = f.source JOIN everyone ON everyone.lang = f.lang
  JOIN each ON each.lang = f.lang AND each.term = f.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), f AS (
  SELECT r, unnest(w) AS f FROM d
), t AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), h AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hex(f)), 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT)),
                            lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f FROM f UNION SELECT f FROM t), crc
), s AS (
  SELECT b, count(*) AS s FROM f JOIN h USING (f) GROUP BY b
), u AS (
  SELECT b, count(*) AS t FROM t JOIN h USING (f) GROUP BY b
), g AS (
  SELECT s.b, floor(1000 * ln((coalesce(u.t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * ((SELECT count(*) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN u ON u.b = s.b
), w AS (
  SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN h USING (f) JOIN g USING (b) GROUP BY r
), e AS (
  SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w ON w.r = d.r
), x AS (
  SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e
), k AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank FROM x WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM k) THEN rank END AS rank FROM x LEFT JOIN k ON k.r = x.r
"""
