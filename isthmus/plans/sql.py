"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

BIP = "WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS src, l_suppkey + 1000000000000 AS dst FROM lineitem), e AS (SELECT src, dst FROM b UNION ALL SELECT dst, src FROM b), deg AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src)"
TRADE_CTE = "WITH t AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)"
PT = "WITH RECURSIVE pt AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"

GRAPH_COUNTS = f"{BIP} SELECT n AS nodes, m AS edges, round(2.0 * m / n, 6) AS avg_degree, round((m - n + 1) / (2 * n - 5), 6) AS meshedness FROM (SELECT count(*) AS n FROM deg), (SELECT count(*) AS m FROM b)"
DEGREE_TABLE = f"{BIP} SELECT id, degree FROM deg"
DEGREE_CDF = BIP + ", h AS (SELECT degree, count(*) AS cnt FROM deg GROUP BY degree), s AS (SELECT unnest(range(0, (SELECT max(degree) FROM h) + 1)) AS degree), f AS (SELECT degree, coalesce(cnt, 0) AS cnt, (SELECT sum(cnt) FROM h) AS n FROM s LEFT JOIN h USING (degree)), g AS (SELECT degree, cnt, round(cnt / n, 6) AS frac, round(sum(cnt) OVER (ORDER BY degree) / n, 6) AS cdf FROM f) SELECT {columns} FROM g"
AVERAGE_DEGREE = f"{BIP} SELECT round(avg(degree), 6) AS avg_degree FROM deg"
MAX_DEGREE = f"{BIP} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 1"

SYMMETRISE = f"{TRADE_CTE} SELECT src, dst FROM t UNION SELECT dst, src FROM t"
TRANSPOSE = f"{TRADE_CTE} SELECT dst AS src, src AS dst FROM t"
CANONICAL = f"{TRADE_CTE} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM t"
IS_UNDIRECTED = f"{TRADE_CTE} SELECT count(*) AS one_way FROM t WHERE (dst, src) NOT IN (SELECT src, dst FROM t)"
ADD_EDGES = f"{TRADE_CTE} SELECT src, dst FROM t UNION SELECT CAST(n_nationkey AS BIGINT), CAST(n_regionkey + 100 AS BIGINT) FROM nation"
REMOVE_EDGES = f"{TRADE_CTE} SELECT src, dst FROM t EXCEPT SELECT CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation"
CLEAR_VERTEX = f"{TRADE_CTE}, v AS (SELECT src AS id FROM t UNION SELECT dst FROM t) SELECT id, count(src) AS degree FROM v LEFT JOIN (SELECT * FROM t WHERE src <> 3 AND dst <> 3) ON id = src GROUP BY id"
HAS_EDGE = f"{TRADE_CTE} SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, EXISTS (SELECT 1 FROM t WHERE t.src = n_nationkey AND t.dst = n_regionkey) AS present FROM nation"
DEDUP_POINTS = f"{PT}, k AS (SELECT id, CAST(round(x * 100) AS BIGINT) AS kx, CAST(round(y * 100) AS BIGINT) AS ky FROM pt) SELECT kx, ky, min(id) AS id, count(*) AS cnt FROM k GROUP BY kx, ky"
COORDS_TO_GRAPH = """WITH s AS (SELECT l_orderkey % 97 AS ux, l_suppkey % 89 AS uy, l_partkey % 97 AS vx, l_suppkey % 83 AS vy FROM lineitem),
p AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS id FROM (SELECT ux AS x, uy AS y FROM s UNION SELECT vx, vy FROM s))
SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM s JOIN p a ON a.x = ux AND a.y = uy JOIN p b ON b.x = vx AND b.y = vy WHERE a.id <> b.id"""
CSR_OFFSETS = f"{BIP} SELECT id, CAST(sum(degree) OVER (ORDER BY id) - degree AS BIGINT) AS first_out FROM deg"
ADJACENCY = f"{TRADE_CTE}, v AS (SELECT src AS id FROM t UNION SELECT dst FROM t) SELECT id, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS neighbours FROM v LEFT JOIN t ON id = src GROUP BY id"
REINDEX = f"{BIP} SELECT id AS old, row_number() OVER (ORDER BY id) - 1 AS id FROM deg"
INDUCED = f"{BIP} SELECT src, dst FROM b JOIN orders ON src = o_orderkey WHERE o_custkey % 2 = 0"

RADIUS_JOIN = f"{PT} SELECT a.id AS u, b.id AS v, round({D2}, 6) AS d2 FROM pt a JOIN pt b ON a.id < b.id WHERE {D2} <= 0.05 * 0.05"
UNIT_DISK = f"{PT} SELECT a.id AS src, b.id AS dst FROM pt a JOIN pt b ON a.id < b.id WHERE {D2} < 0.05 * 0.05"
KNN = f"{PT}, near AS (SELECT a.id AS u, b.id AS v, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rank FROM pt a JOIN pt b ON a.id <> b.id)"
KNN_JOIN = f"{KNN} SELECT u, v, round(d2, 6) AS d2, rank FROM near WHERE rank <= 3"
KNN_EDGES = "(SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM near WHERE rank <= 3)"
KNN_GRAPH = f"{KNN} SELECT src, dst FROM {KNN_EDGES}"
NEAREST = f"{KNN} SELECT u, v, round(d2, 6) AS d2 FROM near WHERE rank = 1"
POLYGON = ([-0.21, 0.19, 0.11, 0.23, -0.02, -0.17], [-0.16, -0.22, 0.01, 0.24, 0.09, 0.18])
_CORNERS = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {POLYGON[0][(i + 1) % 6]}::DOUBLE, {POLYGON[1][(i + 1) % 6]}::DOUBLE)" for i, (x, y) in enumerate(zip(*POLYGON, strict=True)))
IN_POLYGON = f"{PT}, s(i, x1, y1, x2, y2) AS (VALUES {_CORNERS}) SELECT id, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM pt, s GROUP BY id"
POLYGON_MEASURES = f"WITH s(i, x1, y1, x2, y2) AS (VALUES {_CORNERS}), m AS (SELECT sum(x1 * y2 - x2 * y1) AS a2, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM s) SELECT round(abs(a2) / 2, 6) AS area, round(mx / (3 * a2), 6) AS cx, round(my / (3 * a2), 6) AS cy FROM m"
SEGMENTS = f"{KNN}, seg AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS e, src, dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {KNN_EDGES} JOIN pt a ON a.id = src JOIN pt b ON b.id = dst)"
SEGMENT_BOX = f"{SEGMENTS} SELECT a.e AS e1, b.e AS e2 FROM seg a JOIN seg b ON a.e < b.e AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)"
_CROSS = f"""{SEGMENTS}, c AS (
SELECT a.src AS s1, a.dst AS d1, b.src AS s2, b.dst AS d2, a.x1, a.y1, a.x2, a.y2, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4,
(a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS den, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS tn, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS un
FROM seg a JOIN seg b ON a.e < b.e), p AS (SELECT *, x1 + tn / den * (x2 - x1) AS x, y1 + tn / den * (y2 - y1) AS y FROM c WHERE den <> 0 AND tn / den > 0 AND tn / den < 1 AND un / den > 0 AND un / den < 1),
crossing AS (SELECT * FROM p WHERE {" AND ".join(f"(x - x{k}) * (x - x{k}) + (y - y{k}) * (y - y{k}) > 1e-8" for k in (1, 2, 3, 4))})"""
CROSSINGS = f"{_CROSS} SELECT s1, d1, s2, d2, round(x, 6) AS x, round(y, 6) AS y FROM crossing"
PLANARIZE = f"{_CROSS} SELECT (SELECT count(*) FROM pt) + (SELECT count(*) FROM crossing) AS vertices, (SELECT count(*) FROM seg) + 2 * (SELECT count(*) FROM crossing) AS edges"

DELAUNAY = f"""{PT}, pairs AS (SELECT a.id AS src, b.id AS dst, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS nx, b.x - a.x AS ny, {D2} AS d2 FROM pt a JOIN pt b ON a.id < b.id),
side AS (SELECT src, dst, d2, (x - mx) * nx + (y - my) * ny AS a, (x - mx) * (x - mx) + (y - my) * (y - my) - d2 / 4 AS b FROM pairs JOIN pt ON id <> src AND id <> dst),
dt AS (SELECT src, dst, min(d2) AS d2 FROM side GROUP BY src, dst HAVING coalesce(max(CASE WHEN a < 0 THEN b / (2 * a) END), -1e300) <= coalesce(min(CASE WHEN a > 0 THEN b / (2 * a) END), 1e300) AND count(CASE WHEN a = 0 AND b < 0 THEN 1 END) = 0)
"""
SHORT99 = "SELECT src, dst FROM dt ORDER BY d2, src, dst LIMIT (SELECT CAST(floor(count(*) * 0.99) AS BIGINT) FROM dt)"
MAXLEN = "SELECT src, dst FROM dt WHERE d2 <= 0.05 * 0.05"
GABRIEL = f"{PT}, pairs AS (SELECT a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb, {D2} AS d2 FROM pt a JOIN pt b ON a.id < b.id) SELECT src, dst FROM pairs WHERE NOT EXISTS (SELECT 1 FROM pt w WHERE w.id <> src AND w.id <> dst AND (ax - w.x) * (ax - w.x) + (ay - w.y) * (ay - w.y) + (bx - w.x) * (bx - w.x) + (bb - w.y) * (bb - w.y) < d2)"
RNG = f"{PT}, pairs AS (SELECT a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bb, {D2} AS d2 FROM pt a JOIN pt b ON a.id < b.id), rng AS (SELECT src, dst, sqrt(d2) AS w FROM pairs WHERE NOT EXISTS (SELECT 1 FROM pt w WHERE w.id <> src AND w.id <> dst AND greatest((ax - w.x) * (ax - w.x) + (ay - w.y) * (ay - w.y), (bx - w.x) * (bx - w.x) + (bb - w.y) * (bb - w.y)) < d2)) "
RNG_REFERENCE = """, adj AS (SELECT src AS p, dst AS w FROM dt UNION ALL SELECT dst, src FROM dt),
witness AS (SELECT dt.src, dt.dst, dt.d2, greatest((s.x - k.x) * (s.x - k.x) + (s.y - k.y) * (s.y - k.y), (t.x - k.x) * (t.x - k.x) + (t.y - k.y) * (t.y - k.y)) AS far FROM dt JOIN adj m ON m.p = dt.src JOIN adj n ON n.p = dt.dst AND n.w = m.w JOIN pt s ON s.id = dt.src JOIN pt t ON t.id = dt.dst JOIN pt k ON k.id = m.w)
SELECT src, dst FROM dt WHERE (src, dst) NOT IN (SELECT src, dst FROM witness WHERE far < d2)"""

UD = PT + ", ud AS (SELECT a.id AS src, b.id AS dst, sqrt(" + D2 + ") AS w FROM pt a JOIN pt b ON a.id < b.id WHERE " + D2 + " < {r} * {r}), e AS (SELECT src, dst, w FROM ud UNION ALL SELECT dst, src, w FROM ud)"
EDGE_LENGTHS = UD.format(r=0.05) + " SELECT src, dst, round(w, 6) AS w FROM ud"
_BINS = UD.format(r=0.05) + ", h(bin, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 0.01::DOUBLE), (1, 0.01::DOUBLE, 0.02::DOUBLE), (2, 0.02::DOUBLE, 0.03::DOUBLE), (3, 0.03::DOUBLE, 0.04::DOUBLE), (4, 0.04::DOUBLE, 0.05::DOUBLE)), c AS (SELECT CAST(bin AS BIGINT) AS bin, lo, hi, count(w) AS cnt FROM h LEFT JOIN ud ON w > lo AND w <= hi GROUP BY bin, lo, hi)"
HISTOGRAM = _BINS + " SELECT bin, lo, hi, cnt FROM c"
DENSITY = _BINS + " SELECT bin, round(cnt / (SELECT sum(cnt) FROM c) / (hi - lo), 6) AS density, round(sum(cnt) OVER (ORDER BY bin) / (SELECT sum(cnt) FROM c), 6) AS cdf FROM c"
BIN_EDGES = "SELECT i, round(i * (4 + 1e-6) / 4, 8) AS edge FROM range(5) r(i)"

SIZES = "WITH z AS (SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY l_partkey)"
BINNED_LOGLOG = f"{SIZES}, l AS (SELECT log2(n) AS x, log2(s) AS y FROM z) SELECT CAST(floor(8 * x / (SELECT max(x) FROM l)) AS BIGINT) AS bin, count(*) AS cnt, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM l GROUP BY 1"
LOGLOG_FIT = f"{SIZES} SELECT round(regr_slope(log2(s), log2(n)), 6) AS slope, round(regr_intercept(log2(s), log2(n)), 6) AS intercept, round(corr(log2(s), log2(n)), 6) AS r, round(regr_r2(log2(s), log2(n)), 6) AS r2 FROM z WHERE n > 8"
CBRT_FIT = f"{SIZES} SELECT round(regr_slope(s, cbrt(n)), 6) AS slope, round(regr_intercept(s, cbrt(n)), 6) AS intercept, round(regr_r2(s, cbrt(n)), 6) AS r2 FROM z"
SQRT_FIT = f"{SIZES} SELECT round(sum(s * sqrt(n)) / sum(sqrt(n) * sqrt(n)), 6) AS a FROM z"
CBRT_ORIGIN = f"{SIZES} SELECT round(sum(s * cbrt(n)) / sum(cbrt(n) * cbrt(n)), 6) AS a FROM z"
POWER_FIT = f"{SIZES}, f AS (SELECT k / 20.0::DOUBLE AS b, pow(n, k / 20.0::DOUBLE) AS f, s FROM z, range(1, 21) r(k)), g AS (SELECT b, regr_slope(s, f) AS a, regr_intercept(s, f) AS c, regr_syy(s, f) - regr_sxy(s, f) * regr_sxy(s, f) / regr_sxx(s, f) AS sse FROM f GROUP BY b) SELECT round(b, 6) AS b, round(a, 3) AS a, round(c, 3) AS c FROM g ORDER BY sse, b LIMIT 1"
BOX_BINS = f"{SIZES} SELECT CAST(floor(n / 5) AS BIGINT) AS bin, count(*) AS cnt, round(quantile_cont(s, 0.25), 6) AS q1, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS q3 FROM z GROUP BY 1"
HIST2D = f"{PT}, m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt) SELECT CAST(least(floor(10 * (x - x0) / (x1 - x0)), 9) AS BIGINT) AS bx, CAST(least(floor(10 * (y - y0) / (y1 - y0)), 9) AS BIGINT) AS by, count(*) AS cnt FROM pt, m GROUP BY 1, 2"

BFS = f"{BIP}, walk(id, d) AS (SELECT min(src), CAST(0 AS BIGINT) FROM e UNION SELECT e.dst, d + 1 FROM walk JOIN e ON walk.id = e.src WHERE d < 10), dist AS (SELECT id, min(d) AS d FROM walk GROUP BY id) "
LATTICE = "WITH RECURSIVE v AS (SELECT id FROM range({k} * {k}) r(id)), e AS (SELECT id AS src, id + 1 AS dst FROM v WHERE id % {k} < {k} - 1 UNION ALL SELECT id + 1, id FROM v WHERE id % {k} < {k} - 1 UNION ALL SELECT id, id + {k} FROM v WHERE id < {k} * ({k} - 1) UNION ALL SELECT id + {k}, id FROM v WHERE id < {k} * ({k} - 1))"
PATH = ", walk(id, d) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, d + 1 FROM walk JOIN e ON walk.id = e.src WHERE d < 22), dist AS (SELECT id, min(d) AS d FROM walk GROUP BY id), path(step, id) AS (SELECT CAST(d AS BIGINT), id FROM dist WHERE id = 143 UNION ALL SELECT step - 1, (SELECT min(e.src) FROM e JOIN dist ON dist.id = e.src WHERE e.dst = path.id AND dist.d = path.step - 1) FROM path WHERE step > 0) SELECT step, id FROM path"
ALL_PAIRS = ", walk(source, id, d) AS (SELECT id, id, CAST(0 AS BIGINT) FROM v UNION SELECT source, e.dst, d + 1 FROM walk JOIN e ON walk.id = e.src WHERE d < 14), hops AS (SELECT source, id, min(d) AS d FROM walk GROUP BY source, id) "
DOUBLE_SWEEP = ", walk(id, d) AS (SELECT CAST(143 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.dst, d + 1 FROM walk JOIN e ON walk.id = e.src WHERE d < 22), dist AS (SELECT id, min(d) AS d FROM walk GROUP BY id) SELECT max(d) AS length FROM dist"
SSSP = UD.format(r=0.05) + ", best(id, d) USING KEY (id) AS (SELECT min(src), 0.0::DOUBLE FROM e UNION (SELECT e.dst, min(b.d + e.w) FROM best b JOIN e ON b.id = e.src LEFT JOIN recurring.best r ON r.id = e.dst WHERE r.d IS NULL OR b.d + e.w < r.d GROUP BY e.dst)) SELECT id, round(d, 6) AS d FROM best"
DETOUR = UD.format(r=0.03) + ", q AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS qid, src AS u, dst AS v, w * 1.5 AS bound FROM ud), best(qid, id, d) USING KEY (qid, id) AS (SELECT qid, u, 0.0::DOUBLE FROM q UNION (SELECT b.qid, e.dst, min(b.d + e.w) FROM best b JOIN q ON q.qid = b.qid JOIN e ON b.id = e.src LEFT JOIN recurring.best r ON r.qid = b.qid AND r.id = e.dst WHERE NOT (e.src = u AND e.dst = v) AND NOT (e.src = v AND e.dst = u) AND b.d + e.w < bound AND (r.d IS NULL OR b.d + e.w < r.d) GROUP BY b.qid, e.dst)) SELECT q.qid, EXISTS (SELECT 1 FROM best b WHERE b.qid = q.qid AND b.id = v) AS within FROM q"
WITHIN = UD.format(r=0.03) + f", q AS (SELECT row_number() OVER (ORDER BY a.id, b.id) - 1 AS qid, a.id AS u, b.id AS v, sqrt({D2}) * 1.2 AS bound FROM pt a JOIN pt b ON a.id < b.id WHERE {D2} <= 0.06 * 0.06), best(qid, id, d) USING KEY (qid, id) AS (SELECT qid, u, 0.0::DOUBLE FROM q UNION (SELECT b.qid, e.dst, min(b.d + e.w) FROM best b JOIN q ON q.qid = b.qid JOIN e ON b.id = e.src LEFT JOIN recurring.best r ON r.qid = b.qid AND r.id = e.dst WHERE b.d + e.w < bound AND (r.d IS NULL OR b.d + e.w < r.d) GROUP BY b.qid, e.dst)), a AS (SELECT EXISTS (SELECT 1 FROM best b WHERE b.qid = q.qid AND b.id = v) AS within FROM q) SELECT within, count(*) AS cnt FROM a GROUP BY within"

COMPONENTS = UD + ", reach(id, other) AS (SELECT id, id FROM pt UNION SELECT reach.id, e.dst FROM reach JOIN e ON reach.other = e.src), component AS (SELECT id, min(other) AS component FROM reach GROUP BY id) "
MINUS_SEPARATOR = LATTICE.format(k=9) + ", f AS (SELECT src, dst FROM e WHERE src % 9 <> 4 AND dst % 9 <> 4), reach(id, other) AS (SELECT id, id FROM v WHERE id % 9 <> 4 UNION SELECT reach.id, f.dst FROM reach JOIN f ON reach.other = f.src) SELECT id, min(other) AS component FROM reach GROUP BY id"
# an edge is in the forest if its ends aren't connected by shorter edges
_MST = ", ways AS (SELECT src, dst, w FROM rng UNION ALL SELECT dst, src, w FROM rng), reach(s, t, w, node) AS (SELECT src, dst, w, src FROM rng UNION SELECT s, t, reach.w, ways.dst FROM reach JOIN ways ON reach.node = ways.src WHERE ways.w < reach.w), tree AS (SELECT src, dst, w FROM rng WHERE NOT EXISTS (SELECT 1 FROM reach WHERE s = src AND t = dst AND node = dst))"
MST = _MST + " SELECT src, dst, round(w, 6) AS w FROM tree"
MST_WEIGHT = _MST + " SELECT count(*) AS edges, round(sum(w), 6) AS weight FROM tree"
TREE = "WITH RECURSIVE tree AS (SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent UNION ALL SELECT r_regionkey + 1, 0 FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer), up(id, anc, k) AS (SELECT id, id, CAST(0 AS BIGINT) FROM tree UNION ALL SELECT up.id, parent, k + 1 FROM up JOIN tree ON anc = tree.id WHERE parent IS NOT NULL) "
LCA = ", pairs AS (SELECT c_custkey + 1000 AS u, c_custkey * 2 + 1000 AS v FROM customer WHERE c_custkey * 2 IN (SELECT c_custkey FROM customer)), l AS (SELECT u, v, arg_min(a.anc, a.k) AS lca, min(a.k + b.k) AS distance FROM pairs JOIN up a ON a.id = u JOIN up b ON b.id = v AND a.anc = b.anc GROUP BY u, v) SELECT {columns} FROM l"
CONTRACT = LATTICE.format(k=5) + " SELECT src, dst FROM e WHERE src < dst AND src NOT IN (0, 4, 20, 24) AND dst NOT IN (0, 4, 20, 24) UNION ALL VALUES (1, 5), (3, 9), (15, 21), (19, 23)"
ORIENT = LATTICE.format(k=12) + " SELECT src, dst FROM e WHERE (src * 77 + 5) % 144 < (dst * 77 + 5) % 144"
ELIMINATION = LATTICE.format(k=8) + ", r AS (SELECT id, (id * 37 + 11) % 64 AS rank FROM v), reach(id, other) AS (SELECT id, id FROM v UNION SELECT reach.id, e.dst FROM reach JOIN e ON reach.other = e.src JOIN r a ON a.id = reach.id JOIN r b ON b.id = e.dst WHERE b.rank <= a.rank), up AS (SELECT reach.id, arg_min(b.id, b.rank) AS parent FROM reach JOIN e ON reach.other = e.src JOIN r a ON a.id = reach.id JOIN r b ON b.id = e.dst WHERE b.rank > a.rank GROUP BY reach.id) SELECT v.id, parent FROM v LEFT JOIN up ON up.id = v.id"
SEPARATORS = "SELECT CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, count(*) AS cnt FROM (VALUES (257, 16), (129, 8), (113, 7), (65, 8), (57, 7), (57, 7), (50, 7), (33, 4), (29, 4), (29, 4)) t(n, s) GROUP BY n, s"
NESTED_GRID = "WITH p(width, levels) AS (VALUES (3, 1), (3, 2), (4, 2), (4, 3)), c AS (SELECT width, levels, CAST(pow((width - 1) * (width - 1), l) AS BIGINT) AS cells, l FROM p, range(3) r(l) WHERE l < levels) SELECT CAST(width AS BIGINT) AS width, CAST(levels AS BIGINT) AS levels, CAST(sum(CASE WHEN l = 0 THEN width * width ELSE cells * (width * width - 4) END) AS BIGINT) AS nodes, CAST(sum(cells * 2 * width * (width - 1)) AS BIGINT) AS edges FROM c GROUP BY width, levels"
CBRT_MAXIMAL = "SELECT CAST(n AS BIGINT) AS n, CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges FROM (VALUES (2, 1, 0), (3, 3, 2), (10, 8, 17), (100, 82, 808), (2000, 1482, 63802)) t(n, nodes, edges)"
BASE_LATTICE = "WITH p AS (SELECT a AS x, b AS y FROM range(2, 7, 2) r(a), range(2, 7, 2) s(b)) SELECT x AS ux, y AS uy, x + 2 AS vx, y AS vy FROM p WHERE x < 6 UNION ALL SELECT x, y, x, y + 2 FROM p WHERE y < 6"
