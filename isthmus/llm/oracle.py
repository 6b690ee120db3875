"""DuckDB SQL for the queries that SQL can express."""

from .licenses import scan_sql

OP1 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT r, n, k, item_id FROM grams JOIN windows USING (n, gram)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, n, k FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

OP4 = scan_sql()

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT r, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT r, count(*) AS n FROM grams GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach(r, other) AS (
  SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.other = links.a
), class AS (
  SELECT reach.r, min(o.doc_id) AS class_id, count(*) AS n_class FROM reach JOIN d o ON o.r = reach.other GROUP BY reach.r
), counts AS (
  SELECT a AS r, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_class FROM d JOIN class USING (r) LEFT JOIN counts USING (r)
"""

ANY_CASE = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Places of matches come from the lengths of what stands between them.
OP6 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), patterns(kind, o, p) AS (VALUES
  ('assign', 0, '{ANY_CASE}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{{24,}}'),
  ('run', 3, '[A-Za-z0-9+/_-]{{20,}}'), ('endpoint', 5, 'https?://[^{SPACE}"''<>]+'), ('cut', 6, '\n[ \t]*\n')
), found AS (
  SELECT r, kind, o, p, string_split_regex(t, p) AS pieces, regexp_extract_all(t, p) AS hits FROM d, patterns WHERE regexp_matches(t, p)
), placed AS (
  SELECT r, kind, o, p, k, hits[k] AS m, CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found)
), base AS (
  SELECT r, kind, o, s, s + length(m) AS e FROM placed
  WHERE (kind = 'assign' AND length(regexp_extract(m, p, 2)) >= 6) OR (kind = 'access' AND length(m) >= 20) OR kind = 'hex'
), letters AS (
  SELECT r, s, c, count(*) AS n FROM (SELECT r, s, unnest(string_split(m, '')) AS c FROM placed WHERE kind = 'run') GROUP BY r, s, c
), entropy AS (
  SELECT r, s, -sum(n / total * log2(n / total)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY r, s) AS total FROM letters) GROUP BY r, s
), parts AS (
  SELECT r, CASE WHEN regexp_full_match(m, '[A-Z0-9]+') THEN 'id' ELSE 'secret' END AS kind, CASE WHEN regexp_full_match(m, '[A-Z0-9]+') THEN 3 ELSE 4 END AS o, s, s + length(m) AS e
  FROM placed JOIN entropy USING (r, s)
  WHERE kind = 'run' AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') AND (regexp_full_match(m, '[A-Z0-9]+') OR (regexp_matches(m, '[a-z]') AND bits >= 3.5))
  UNION ALL SELECT r, kind, o, s, s + length(m) FROM placed WHERE kind = 'endpoint'
), weak AS (
  SELECT * FROM parts w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND b.e > w.s)
), scoped AS (
  SELECT w.*, greatest(w.s - 300, coalesce((SELECT max(c.s) FROM placed c WHERE c.r = w.r AND c.kind = 'cut' AND c.s < w.s), 0)) AS low,
    least(w.e + 300, coalesce((SELECT min(c.s) FROM placed c WHERE c.r = w.r AND c.kind = 'cut' AND c.s >= w.s), length(t))) AS high
  FROM weak w JOIN d USING (r)
), every AS (
  SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM weak
), linked AS (
  SELECT r, kind, o, s, e FROM scoped w
  WHERE (kind = 'secret' OR EXISTS (SELECT 1 FROM every x WHERE x.r = w.r AND x.kind IN ('assign', 'hex', 'secret') AND x.s < w.high AND x.e > w.low))
    AND (kind = 'id' OR EXISTS (SELECT 1 FROM every x WHERE x.r = w.r AND x.kind IN ('access', 'id') AND x.s < w.high AND x.e > w.low))
), shown AS (
  SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY r
), counted AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS line FROM base GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(line, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN counted USING (r) LEFT JOIN shown USING (r)
"""

SQL: dict[str, str] = {
    "op1_decontamination": OP1,
    "op4_licenses": OP4,
    "op6_secrets": OP6,
    "op8_jaccard": OP8,
}
