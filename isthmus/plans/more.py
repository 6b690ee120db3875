"""Further queries of the catalogue: file formats by round trip, changes, bins, sweeps, and invariants of what chance or order decides.

A query over random choices or over results with ties returns what must hold of them, counted from the result; its SQL
counts the same from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import dist2, in_polygon, polygon_box
from ..operators import components as comp
from ..operators import diameter as dia
from ..operators import proximity, separator, spanner, spatial, stats, traverse, trees
from ..operators.graph import Graph, numbered
from ..runtime import checkpoint_dir, cut_plan, read_table
from ..sources import boltzmann, formats, generate, studies
from . import sql as Q
from .catalogue import disks, first_order, pt_stored, query, r6, sizes, trade, ud


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/format-{uuid.uuid4().hex}"


def both_ways(spark: SparkSession, d: str) -> Graph:
    g = trade(spark, d).make_undirected()
    return Graph(cut_plan(g.vertices), cut_plan(g.edges))


def nations(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"))


def yes(spark: SparkSession, **columns: object) -> DataFrame:
    """One row of counts and truths."""
    kinds = {int: "long", bool: "boolean", float: "double"}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))


def tied(g: Graph) -> bool:
    return comp.is_connected(g)


# formats

DENSE = Q.TRADE_CTE + ", u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT src AS id FROM u))"
DENSE_EDGES = DENSE + " SELECT a.k AS src, b.k AS dst FROM u JOIN ids a ON a.id = src JOIN ids b ON b.id = dst"


@query(DENSE_EDGES)
def csr_round_trip(spark, d):
    at = place(spark)
    formats.write_csr(both_ways(spark, d), at)
    return formats.read_csr(spark, at).edges


@query(DENSE + " SELECT a.k AS src, b.k AS dst FROM t JOIN ids a ON a.id = src JOIN ids b ON b.id = dst")
def csr_directed_round_trip(spark, d):
    at = place(spark)
    formats.write_csr(trade(spark, d), at)
    return formats.read_csr(spark, at, directed=True).edges


@query(Q.PT + " SELECT row_number() OVER (ORDER BY id) - 1 AS id, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) AS y FROM pt")
def csr_geometric_round_trip(spark, d):
    at, g = place(spark), disks(spark, d, 0.05)
    formats.write_csr(g, at)
    h = formats.read_csr(spark, at, positions=True)
    ok = h.edges.count() == g.degrees().agg(F.sum("degree")).first()[0]
    return h.vertices.where(F.lit(ok)).select("id", r6("x"), r6("y"))


@query(Q.UD.format(r=0.05) + ", ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM pt) SELECT a.k AS src, b.k AS dst FROM ud JOIN ids a ON a.id = src JOIN ids b ON b.id = dst")
def csr_geometric_edges(spark, d):
    at = place(spark)
    formats.write_csr(disks(spark, d, 0.05), at)
    return formats.read_csr(spark, at, positions=True).canonical()


def _vectors(spark, d) -> DataFrame:
    c = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("b"))
    return numbered(c, ["k"], "pos")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, CAST(c_custkey AS BIGINT) AS value FROM customer")
def u32_vector_round_trip(spark, d):
    at = place(spark)
    formats.write_binary_vector(_vectors(spark, d), "k", "pos", at, "I")
    return formats.read_binary_vector(spark, at, "I")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, round(CAST(c_acctbal AS DOUBLE), 6) AS value FROM customer")
def binary_vector_round_trip(spark, d):
    at = place(spark)
    formats.write_binary_vector(_vectors(spark, d), "b", "pos", at, "d")
    return formats.read_binary_vector(spark, at, "d").select("pos", r6("value"))


@query("SELECT value, count(*) AS cnt FROM (SELECT CAST(n_nationkey AS BIGINT) AS value FROM nation UNION ALL SELECT r_regionkey FROM region) GROUP BY value")
def text_vector_round_trip(spark, d):
    """Cleared, written and appended to."""
    at = place(spark)
    formats.clear_file(spark, at)
    formats.write_vector(read_table(spark, d, "nation"), "n_nationkey", at)
    formats.write_vector(read_table(spark, d, "region"), "r_regionkey", at, append=True)
    return formats.read_vector(spark, at, "long").groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))


@query(Q.PT + " SELECT row_number() OVER (ORDER BY id) - 1 AS id, round(x, 6) AS x, round(y, 6) AS y FROM pt")
def points_round_trip(spark, d):
    at = place(spark)
    formats.write_points(pt_stored(spark, d), at, ",")
    return formats.read_points(spark, at).select("id", r6("x"), r6("y"))


@query(DENSE_EDGES + " WHERE src < dst")
def edge_list_round_trip(spark, d):
    at = place(spark)
    formats.write_edge_list(both_ways(spark, d), at)
    return formats.read_edge_list(spark, at)


@query(DENSE_EDGES)
def edge_list_graph(spark, d):
    at = place(spark)
    formats.write_edge_list(both_ways(spark, d), at)
    return formats.read_graph(spark, at).edges


@query(DENSE_EDGES)
def pace_round_trip(spark, d):
    at = place(spark)
    formats.write_pace(both_ways(spark, d), at)
    return formats.read_pace(spark, at).edges


@query(DENSE_EDGES)
def metis_round_trip(spark, d):
    at = place(spark)
    formats.write_metis(both_ways(spark, d), at)
    return formats.read_metis(spark, at).edges


@query(DENSE_EDGES + " WHERE src < dst")
def pigale_round_trip(spark, d):
    at = place(spark)
    formats.write_pigale(both_ways(spark, d), at)
    return formats.read_edge_list(spark, at, base=1, drop_trailer=True)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS rank, CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) AS inverse_node FROM nation")
def order_round_trip(spark, d):
    at = place(spark)
    formats.write_vector(nations(spark, d).select("id", F.expr("(id * 7 + 3) % 25 + 1").alias("rank")), "rank", at, order="id")
    inverse = separator.invert_order(formats.read_order(spark, at)).select(F.col("rank").alias("node"), F.col("node").alias("inverse_node"))
    return formats.read_order(spark, at).join(inverse, "node")


@query("SELECT CAST(n_nationkey + 100 AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS s FROM nation")
def flow_cutter_stats(spark, d):
    at = place(spark)
    nations(spark, d).select((F.col("id") + 100).alias("nodes"), F.lit("x").alias("name"), F.col("region").alias("cut")).write.csv(at, header=True)
    return formats.read_flow_cutter_stats(spark, at)


@query("WITH z AS (SELECT count(*) AS n, CAST(max(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_partkey) SELECT n, s FROM z")
def separators_file(spark, d):
    at = place(spark)
    formats.write_separators(read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("long").alias("s")), at)
    return formats.read_separators(spark, at)


@query(Q._BINS + " SELECT bin, lo, hi, cnt FROM c")
def histogram_file(spark, d):
    at = place(spark)
    formats.write_histogram(stats.histogram(ud(spark, d, 0.05).edge_lengths(), "w", [0.0, 0.01, 0.02, 0.03, 0.04, 0.05]), at)
    lines = [r.value.split(" ") for r in formats._numbered_lines(spark, at).orderBy("n").collect()]  # two lines
    edges, counts = list(map(float, lines[0])), list(map(int, lines[1]))
    return spark.createDataFrame([(i, edges[i], edges[i + 1], c) for i, c in enumerate(counts)], "bin long, lo double, hi double, cnt long")


@query(Q.UD.format(r=0.05) + " SELECT count(*) AS cnt, round(sum(w), 4) AS total, round(max(w), 6) AS longest FROM e")
def edge_length_dump(spark, d):
    at = place(spark)
    formats.write_edge_lengths(disks(spark, d, 0.05), at)
    return formats.read_vector(spark, at).agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("longest"))


@query(f"SELECT count(*) AS cnt, round(sum(d), 4) AS total FROM ({Q.SSSP})")
def distance_dump(spark, d):
    at, g = place(spark), disks(spark, d, 0.05)
    formats.write_distances(g, g.vertices.agg(F.min("id").alias("id")), at)
    return formats.read_vector(spark, at).agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum(F.round("value", 6)), 4).alias("total"))


@query("""WITH w AS (SELECT n_regionkey, n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation)
SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, CAST(a AS DOUBLE) AS x, a / 2.0::DOUBLE AS y FROM w WHERE b IS NOT NULL""")
def osm_read(spark, d):
    """A way for each region, through its nations."""
    at, n = place(spark), nations(spark, d)
    node = n.select(F.lit(0).alias("k"), "id", F.format_string('  <node id="%d" lat="%s" lon="%s"/>', "id", (F.col("id") / 2).cast("string"), F.col("id").cast("double").cast("string")).alias("line"))
    ways = n.groupBy("region").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    way = ways.select(F.lit(1).alias("k"), F.col("region").alias("id"), F.concat(F.format_string('  <way id="%d">', F.col("region") + 100), F.array_join(F.transform("ids", lambda i: F.format_string('<nd ref="%d"/>', i)), ""), F.lit("</way>")).alias("line"))
    ends = spark.createDataFrame([(-1, 0, '<osm version="0.6">'), (2, 0, "</osm>")], "k int, id long, line string")
    node.union(way).union(ends).coalesce(1).orderBy("k", "id").select("line").coalesce(1).write.text(at)
    g = formats.read_osm(spark, at)
    return g.segments().select("src", "dst", F.col("x1").alias("x"), F.col("y1").alias("y"))


# construction and changes


@query(Q.TRADE_CTE + " SELECT src, dst FROM t")
def from_adjacency(spark, d):
    return Graph.from_adjacency(trade(spark, d).adjacency()).edges


@query("SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS edges FROM customer")
def empty_graph(spark, d):
    return stats.counts(Graph.empty(spark, read_table(spark, d, "customer").count())).select("nodes", "edges")


SCALED = """WITH s AS (SELECT CAST(round(CAST(embedding[1] AS DOUBLE) * 100) AS BIGINT) AS ux, CAST(round(CAST(embedding[2] AS DOUBLE) * 100) AS BIGINT) AS uy, CAST(round(CAST(embedding[3] AS DOUBLE) * 100) AS BIGINT) AS vx, CAST(round(CAST(embedding[4] AS DOUBLE) * 100) AS BIGINT) AS vy FROM embeddings),
p AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS id FROM (SELECT ux AS x, uy AS y FROM s UNION SELECT vx, vy FROM s))
SELECT DISTINCT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM s JOIN p a ON a.x = ux AND a.y = uy JOIN p b ON b.x = vx AND b.y = vy WHERE a.id <> b.id"""


@query(SCALED)
def coords_to_graph_scaled(spark, d):
    e = read_table(spark, d, "embeddings")
    return Graph.from_coordinate_edges(e.select(*(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("ux", "uy", "vx", "vy")))), 1e2).canonical()


@query(Q.PT + " SELECT count(*) AS points, true AS fits FROM pt")
def positions_match(spark, d):
    g = ud(spark, d, 0.05)
    return yes(spark, points=g.vertices.count(), fits=g.positions_match())


MORE = "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey + 100 AS BIGINT) AS dst FROM nation"


@query(Q.TRADE_CTE + f", u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), m AS ({MORE}) SELECT src, dst FROM u UNION SELECT src, dst FROM m UNION SELECT dst, src FROM m")
def add_edges_undirected(spark, d):
    return both_ways(spark, d).add_edges(nations(spark, d).select(F.col("id").alias("src"), (F.col("region") + 100).alias("dst"))).edges


@query(Q.TRADE_CTE + ", u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t) SELECT src, dst FROM u WHERE (src, dst) NOT IN (SELECT n_nationkey, n_regionkey FROM nation) AND (dst, src) NOT IN (SELECT n_nationkey, n_regionkey FROM nation)")
def remove_edges_undirected(spark, d):
    return both_ways(spark, d).remove_edges(nations(spark, d).select(F.col("id").alias("src"), F.col("region").alias("dst"))).edges


@query(Q.TRADE_CTE + ", v AS (SELECT src AS id FROM t UNION SELECT dst FROM t UNION SELECT r_regionkey + 1000 FROM region) SELECT id, count(src) AS degree FROM v LEFT JOIN t ON id = src GROUP BY id")
def add_vertices(spark, d):
    more = read_table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"))
    return trade(spark, d).add_vertices(more).degrees()


@query(Q.TRADE_CTE + " SELECT dst AS id FROM t WHERE src = 3")
def neighbours(spark, d):
    return trade(spark, d).neighbours(3)


@query(Q.TRADE_CTE + " SELECT src, dst FROM t UNION ALL SELECT src + 1000, dst + 1000 FROM t")
def disjoint_union(spark, d):
    g = trade(spark, d)
    return g.disjoint_union(g, 1000).edges


@query(Q.TRADE_CTE + " SELECT id, line FROM (SELECT id, id || ': ' || coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '') AS line FROM (SELECT src AS id FROM t UNION SELECT dst FROM t) LEFT JOIN t ON id = src GROUP BY id)")
def adjacency_lines(spark, d):
    return stats.adjacency_lines(trade(spark, d))


@query("SELECT 1 AS nodes, 1 AS incident, 10 AS edges, true AS members")
def random_choices(spark, d):
    """A random vertex, a random edge at a random vertex, ten random edges: all are of the graph."""
    g = both_ways(spark, d)
    v, i, e = (cut_plan(x) for x in (g.random_vertex(3), g.random_incident_edge(3), g.random_edges(10, 3)))
    known = v.join(g.vertices, "id", "left_anti").isEmpty() and all(x.select("src", "dst").join(g.edges, ["src", "dst"], "left_anti").isEmpty() for x in (i, e))
    return yes(spark, nodes=v.count(), incident=i.count(), edges=e.distinct().count(), members=known).select(*(F.col(c).cast("int").alias(c) for c in ("nodes", "incident", "edges")), "members")


@query(Q.BIP + " SELECT (SELECT count(*) FROM b) - 1000 AS left_over, true AS subset")
def removed_random_edges(spark, d):
    g = catalogue_bip(spark, d)
    left = cut_plan(g.remove_random_edges(1000, 7).canonical())
    return yes(spark, left_over=left.count(), subset=left.join(g.edges, ["src", "dst"], "left_anti").isEmpty())


def catalogue_bip(spark, d) -> Graph:
    from .catalogue import bip_stored

    return bip_stored(spark, d)


@query(Q.LATTICE.format(k=12) + " SELECT count(*) - 1 AS edges, true AS connected FROM e WHERE src < dst")
def remove_edge_connected(spark, d):
    g, _, _ = generate.lattice(spark, 12).remove_random_edge_connected(5)
    return yes(spark, edges=g.canonical().count(), connected=tied(g))


@query(Q.BIP + " SELECT CAST(floor(count(*) * 1.5 / 2) AS BIGINT) AS edges, count(*) AS nodes FROM deg")
def average_degree_enforced(spark, d):
    g = catalogue_bip(spark, d).enforce_average_degree(1.5, 3)
    return stats.counts(g).select("edges", "nodes")


@query("SELECT true AS within_targets, true AS connected, true AS subset")
def thinned_to_degrees(spark, d):
    """Shares of a road network's degrees; the largest component may hold fewer vertices of a degree than all do."""
    from ..sources.kernels import ROAD_DEGREES

    g = ud(spark, d, 0.04)
    h = g.thin_to_degrees(ROAD_DEGREES, 5)
    h = Graph(cut_plan(h.vertices), cut_plan(h.edges))
    n = g.vertices.count()
    most = {r.degree: r["count"] for r in h.degrees().groupBy("degree").count().collect()}
    return yes(spark, within_targets=all(k <= 1.2 * int(ROAD_DEGREES.get(x, 0) * n) for x, k in most.items() if x > 1), connected=tied(h), subset=h.edges.join(g.edges, ["src", "dst"], "left_anti").isEmpty())


def subdivided(spark: SparkSession, k: int) -> Graph:
    """A lattice of which every edge is a path of three vertices."""
    e = generate.lattice(spark, k).canonical()
    mid = (F.col("src") * 1000 + F.col("dst") + 1000).alias("m")
    return Graph.from_edges(e.select("src", mid).toDF("src", "dst").union(e.select(mid, "dst").toDF("src", "dst")))


@query(Q.CONTRACT)
def contracted_component(spark, d):
    return comp.largest_component(comp.contract_degree2(subdivided(spark, 5))).canonical()


# statistics


@query(Q._BINS + " SELECT bin, lo, hi, 2 * cnt AS cnt FROM c")
def added_histograms(spark, d):
    h = stats.histogram(ud(spark, d, 0.05).edge_lengths(), "w", [0.0, 0.01, 0.02, 0.03, 0.04, 0.05])
    return stats.add_histograms(h, h).select(F.col("bin").cast("long").alias("bin"), "lo", "hi", "cnt")


@query(Q.SIZES + " SELECT n, round(pow(s, 3), 3) AS cubed, round(pow(s, 2), 3) AS squared FROM z WHERE n < 30")
def transformed_sizes(spark, d):
    z = stats.without_outliers(sizes(spark, d), "n", 30)
    both = stats.to_power(stats.to_power(z.withColumns({"cubed": F.col("s"), "squared": F.col("s")}), "cubed", 3), "squared", 2)
    return both.select("n", F.round("cubed", 3).alias("cubed"), F.round("squared", 3).alias("squared"))


BINNED = Q.SIZES + ", m AS (SELECT max(n)::DOUBLE AS top FROM z), b AS (SELECT CAST(least(floor({at} * 9), 8) AS BIGINT) AS bin, s, top FROM z, m) SELECT bin, round({centre}, 6) AS centre, round(avg(s), 6) AS mean FROM b GROUP BY bin, top"


@query(BINNED.format(at="n / top", centre="top * (2 * bin + 1) / 18"))
def binned_linear(spark, d):
    return stats.binned_statistic(sizes(spark, d), "n", "s", 10).select("bin", r6("centre"), r6("mean"))


@query(BINNED.format(at="(ln(n) / ln(top))", centre="exp(ln(top) * (2 * bin + 1) / 18)"))
def binned_geometric(spark, d):
    return stats.binned_statistic(sizes(spark, d), "n", "s", 10, log=True).select("bin", r6("centre"), r6("mean"))


@query(Q.SIZES + ", l AS (SELECT log2(n) AS x, log2(s) AS y FROM z), m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l) SELECT CAST(least(floor(8 * (x - x0) / (x1 - x0)), 7) AS BIGINT) AS bx, CAST(least(floor(8 * (y - y0) / (y1 - y0)), 7) AS BIGINT) AS by, count(*) AS cnt FROM l, m GROUP BY 1, 2")
def hist2d_log(spark, d):
    return stats.hist2d_log(sizes(spark, d), "n", "s", 8)


@query(Q.SIZES + ", b AS (SELECT floor(n / 5) AS bin, quantile_cont(s, 0.5) AS median FROM z GROUP BY 1), r AS (SELECT bin * 5 + 2.5 AS x, median AS y FROM b WHERE median > 0), f AS (SELECT regr_slope(log2(y), log2(x)) AS m FROM r) SELECT round(m, 6) AS m, round(sum(y * pow(x, m)) / sum(pow(x, 2 * m)), 6) AS a FROM r, f GROUP BY m")
def power_fit_on_medians(spark, d):
    return stats.power_fit_on_medians(stats.box_bins(sizes(spark, d), "n", "s", 5), F.col("bin") * 5 + 2.5).select(r6("m"), r6("a"))


@query("WITH r AS (SELECT l_partkey AS run_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS m FROM lineitem GROUP BY l_partkey) SELECT CAST(run_id AS BIGINT) AS run_id, n, m, round((m - 2.2132652385 * n) / sqrt(n), 6) AS excess FROM r WHERE m > 700")
def sample_statistics(spark, d):
    r = read_table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("m"))
    return stats.sample_statistics(r, least_edges=700).select("run_id", "n", "m", r6("excess"))


@query(Q._CROSS + ", z AS (SELECT (SELECT count(*) FROM pt) + (SELECT count(*) FROM crossing) AS n, (SELECT count(*) FROM seg) + 2 * (SELECT count(*) FROM crossing) AS m) SELECT round((m - n + 1) / (2 * n - 5), 6) AS meshedness FROM z")
def planar_meshedness(spark, d):
    from ..operators import planar

    p = pt_stored(spark, d)
    g = planar.planarize(Graph.from_edges(cut_plan(proximity.knn_edges(p, 3)), p))
    return stats.counts(g).select(r6("meshedness"))


_BOX = ", ".join(f"round({f}({c}), 6) AS {n}" for f, c, n in (("min", "x1", "x0"), ("min", "y1", "y0"), ("max", "x1", "x1"), ("max", "y1", "y1")))


@query(f"WITH s(i, x1, y1, x2, y2) AS (VALUES {Q._CORNERS}) SELECT {_BOX} FROM s")
def polygon_bounding_box(spark, d):
    xs, ys = (F.array(*map(F.lit, c)) for c in Q.POLYGON)
    return spark.range(1).select(*(F.round(c, 6).alias(n) for c, n in zip(polygon_box(xs, ys), ("x0", "y0", "x1", "y1"), strict=True)))


# traversals on lattices, whose distances are known in closed form

GRID = "WITH v AS (SELECT id, id // {k} AS i, id % {k} AS j FROM range({k} * {k}) r(id)), far AS (SELECT a.id AS source, b.id AS id, abs(a.i - b.i) + abs(a.j - b.j) AS d FROM v a, v b)"


def unit_lattice(spark: SparkSession, k: int) -> Graph:
    g = generate.lattice(spark, k).weighted()
    return Graph(g.vertices, cut_plan(g.edges))


@query(GRID.format(k=12) + " SELECT count(*) AS nodes, true AS half_way FROM v WHERE id = 0")
def path_midpoint(spark, d):
    """The middle of a path between opposite corners is half-way from both."""
    g = generate.lattice(spark, 12)
    m = traverse.path_midpoint(g, 0, 143)
    return yes(spark, nodes=1, half_way=m // 12 + m % 12 == 11)


@query(f"SELECT source, target, d FROM (SELECT (SELECT min(id) FROM z) AS source, id AS target, d FROM ({Q.SSSP}) z) WHERE d > 0 ORDER BY d DESC, target LIMIT 1".replace("(SELECT min(id) FROM z)", "(SELECT min(CAST(vec_id AS BIGINT)) FROM embeddings)"))
def shortest_distance(spark, d):
    """To the farthest vertex, found by the search over all."""
    g = disks(spark, d, 0.05)
    s = first_order(g)
    t = traverse.sssp(g, s).select("id", F.round("d", 6).alias("d")).orderBy(F.desc("d"), "id").first()["id"]
    return traverse.shortest_distance(g, s, t).select("source", "target", r6("d"))


@query(GRID.format(k=7) + " SELECT count(*) AS asked, count(*) FILTER (WHERE d <= 4) AS up_to, count(*) FILTER (WHERE d < 4) AS below FROM far WHERE source < id")
def within_distance_bounds(spark, d):
    """Up to a bound and below it, over all pairs."""
    g = unit_lattice(spark, 7)
    pairs = g.vertices.select(F.col("id").alias("u")).join(g.vertices.select(F.col("id").alias("v")), F.col("u") < F.col("v"))
    q = cut_plan(pairs.select((F.col("u") * 49 + F.col("v")).alias("qid"), "u", "v", F.lit(4.0).alias("bound")))
    count = lambda strict: traverse.within_distance(g, q, strict=strict).where("within").count()
    return yes(spark, asked=q.count(), up_to=count(False), below=count(True))


@query(GRID.format(k=9) + " SELECT source, count(*) AS cnt, round(CAST(sum(d) AS DOUBLE), 6) AS total FROM far WHERE source % 20 = 0 GROUP BY source")
def distance_overview(spark, d):
    g = unit_lattice(spark, 9)
    return traverse.multi_sssp(g, g.vertices.where("id % 20 = 0")).groupBy("source").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("d"), 6).alias("total"))


@query(GRID.format(k=9) + ", m AS (SELECT max(d) + 1e-6 AS top FROM far WHERE source % 20 = 0) SELECT CAST(b AS BIGINT) AS bin, count(d) AS cnt FROM range(4) r(b) CROSS JOIN m LEFT JOIN far ON source % 20 = 0 AND d > b * top / 4 AND d <= (b + 1) * top / 4 GROUP BY b")
def distance_histogram(spark, d):
    g = unit_lattice(spark, 9)
    return traverse.distance_histogram(g, g.vertices.where("id % 20 = 0"), 4).select(F.col("bin").cast("long").alias("bin"), "cnt")


@query(GRID.format(k=10) + " SELECT max(d) AS sweeps, CAST(max(d) AS DOUBLE) AS weighted, CAST(max(d) AS DOUBLE) AS bound FROM far")
def sweeps(spark, d):
    """On a lattice every sweep finds the diameter: random double sweeps, a weighted one, and weighted searches from all vertices."""
    g = unit_lattice(spark, 10)
    return yes(spark, sweeps=dia.random_double_sweeps(g, 5, 1), weighted=float(round(dia.weighted_double_sweep(g, 37).first()["d"], 6)), bound=float(round(dia.weighted_diameter_bound(g, 100, 1), 6)))


CONTRACTED = Q.CONTRACT.replace("SELECT src, dst FROM e", ", c AS (SELECT src, dst FROM e", 1) + "), f AS (SELECT src, dst FROM c UNION SELECT dst, src FROM c), reach(source, id, d) AS (SELECT src, src, CAST(0 AS BIGINT) FROM f UNION SELECT source, f.dst, d + 1 FROM reach JOIN f ON reach.id = f.src WHERE d < 12), hop AS (SELECT source, id, min(d) AS d FROM reach GROUP BY source, id)"


@query(CONTRACTED + " SELECT max(d) AS diameter, true AS lower_bound FROM hop")
def contracted_double_sweep(spark, d):
    g = subdivided(spark, 5)
    small = comp.largest_component(comp.contract_degree2(g))
    exact = dia.all_bfs_diameter(Graph(cut_plan(small.vertices), cut_plan(small.edges)))
    return yes(spark, diameter=exact, lower_bound=dia.contracted_double_sweep(g).first()["d"] <= exact)


@query(Q.LATTICE.format(k=16) + " SELECT CAST(max(id) + 1 AS BIGINT) AS n, CAST(30 AS BIGINT) AS diameter, true AS smaller FROM v")
def recursive_diameters(spark, d):
    """The lattice's own size and diameter come first; parts are smaller, and their diameters fit their sizes."""
    rows = separator.recursive_diameters(generate.lattice(spark, 16), least=60).collect()
    top = [r for r in rows if r.level == 0]
    rest = [r for r in rows if r.level]
    return yes(spark, n=top[0].n, diameter=top[0].diameter, smaller=len(top) == 1 and len(rest) > 3 and all(r.n < 256 and r.n ** 0.5 - 2 <= r.diameter < r.n for r in rest))


# components, proximity graphs, spanners


@query(Q.COMPONENTS.format(r=0.02) + ", big AS (SELECT component FROM component GROUP BY component HAVING count(*) > 3) SELECT id, component FROM component WHERE component IN (SELECT component FROM big)")
def parts_above(spark, d):
    g = ud(spark, d, 0.02)
    return comp.components_minus_separator(g, g.vertices.limit(0), min_size=3)


@query("SELECT count(*) AS nodes, CAST(floor(1.25 * count(*)) AS BIGINT) AS edges, true AS connected FROM embeddings")
def spatial_tree_counts(spark, d):
    g = generate.spatial_tree_3d(spark, read_table(spark, d, "embeddings").count(), seed=5)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    c = stats.counts(g).first()
    return yes(spark, nodes=c.nodes, edges=c.edges, connected=tied(g))


@query("SELECT true AS connected, true AS thinned, true AS subset")
def thinned_proximity_graphs(spark, d):
    """Unit disks and Delaunay edges at an average degree: connected, no longer edges than before, no more edges than asked for."""
    p = pt_stored(spark, d)
    n = p.count()
    graphs = [(proximity.unit_disk_graph(p, 0.06, 2.5, 1), proximity.unit_disk_edges(p, 0.06)), (proximity.delaunay_average_degree(p, 3.0, 1), proximity.delaunay_edges(p)), (proximity.knn_graph(p, 3), proximity.knn_edges(p, 3))]
    kept = [(Graph(cut_plan(g.vertices), cut_plan(g.edges)), e) for g, e in graphs]
    most = (2.5, 3.0, 99.0)
    return yes(spark, connected=all(tied(g) for g, _ in kept), thinned=all(g.canonical().count() <= n * m / 2 for (g, _), m in zip(kept, most, strict=True)), subset=all(g.canonical().select("src", "dst").join(e, ["src", "dst"], "left_anti").isEmpty() for g, e in kept))


@query(Q.IN_POLYGON.replace("SELECT id, count(*)", ", q AS (SELECT id, count(*)", 1) + ") SELECT id, CAST(7 AS BIGINT) AS polygon FROM q WHERE inside")
def points_in_polygons(spark, d):
    xs, ys = Q.POLYGON
    shapes = spark.createDataFrame([(7, list(map(float, xs)), list(map(float, ys)))], "polygon long, xs array<double>, ys array<double>")
    return spatial.points_in_polygons(pt_stored(spark, d), shapes)


def stretched(spark: SparkSession, full: Graph, kept: Graph, stretch: float) -> tuple[int, bool]:
    """Number of edges of the full graph, and whether each has a path of at most stretch times its length (a little more for rounding) in the kept part."""
    kept = Graph(kept.vertices, cut_plan(kept.edges.select("src", "dst"))).weighted()
    kept = Graph(kept.vertices, cut_plan(kept.edges))
    q = numbered(full.edge_lengths(), ["src", "dst"], "qid").select("qid", F.col("src").alias("u"), F.col("dst").alias("v"), (F.col("w") * stretch * (1 + 1e-9)).alias("bound"))
    q = cut_plan(q)
    return q.count(), traverse.within_distance(kept, q, strict=False).where("NOT within").isEmpty()


def _spanner(spark: SparkSession, d: str, make, stretch: float) -> DataFrame:
    p = pt_stored(spark, d)
    full = Graph.from_edges(cut_plan(proximity.delaunay_edges(p)), p)
    edges, ok = stretched(spark, full, make(full), stretch)
    return yes(spark, edges=edges, within_stretch=ok)


STRETCH = Q.DELAUNAY + "SELECT count(*) AS edges, true AS within_stretch FROM dt"


@query(STRETCH)
def pruned_stretch(spark, d):
    """Detours that let an edge go are found again, but for chains of edges gone later: each costs the factor once more."""
    return _spanner(spark, d, lambda g: spanner.prune_detours(g, 1.5), 1.5**4)


@query(Q.DELAUNAY + "SELECT count(*) AS edges, true AS subset, true AS fewer FROM dt")
def pruned_in_batches(spark, d):
    """Edges tried on one state may let each other go, so no stretch is promised; what is left is a part of the triangulation."""
    p = pt_stored(spark, d)
    full = Graph.from_edges(cut_plan(proximity.delaunay_edges(p)), p)
    left = cut_plan(spanner.prune_detours(full, 1.5, batch=8).canonical().select("src", "dst"))
    n = full.canonical().count()
    return yes(spark, edges=n, subset=left.join(full.edges, ["src", "dst"], "left_anti").isEmpty(), fewer=left.count() < n)


@query(STRETCH)
def greedy_stretch(spark, d):
    return _spanner(spark, d, lambda g: spanner.greedy_spanner(g, 4.0), 4.0)


@query(STRETCH)
def greedy_stretch_ascending(spark, d):
    return _spanner(spark, d, lambda g: spanner.greedy_spanner(g, 2.0, ascending=True), 2.0)


# separators


@query("SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS different FROM embeddings")
def dissection_is_an_order(spark, d):
    p = pt_stored(spark, d)
    g = Graph.from_edges(cut_plan(proximity.delaunay_edges(p)), p)
    return separator.nested_dissection(g).agg(F.countDistinct("node").alias("nodes"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.countDistinct("rank").alias("different"))


@query("SELECT true AS parted, true AS balanced, true AS small")
def separator_parts(spark, d):
    """The separator of a triangulation leaves several parts, none above two thirds, and has at most a few times the root of n vertices."""
    p = pt_stored(spark, d)
    g = Graph.from_edges(cut_plan(proximity.delaunay_edges(p)), p)
    cut = cut_plan(separator.node_separator(g).select("id"))
    left = comp.components_minus_separator(g, cut).groupBy("component").count().collect()  # one row a part
    n = g.vertices.count()
    shown = separator.separator_extension(g, cut).first()
    return yes(spark, parted=len(left) > 1 and shown.parts == len(left), balanced=max(r["count"] for r in left) <= 0.67 * n, small=shown["size"] <= 4 * n**0.5)


@query("SELECT true AS follows_one, true AS in_budget, true AS shrinks")
def separator_recursions(spark, d):
    """Largest part and queue: one separator a level or as many as allowed, over ever smaller parts."""
    g = generate.lattice(spark, 8)
    largest = separator.separate_recursively(g, 20, follow="largest").orderBy("level").collect()
    queue = separator.separate_recursively(g, 20, most=2).collect()
    return yes(spark, follows_one=[r.level for r in largest] == list(range(len(largest))) and len(largest) > 1, in_budget=len(queue) == 2, shrinks=all(a.n > b.n for a, b in zip(largest, largest[1:], strict=False)) and largest[0].n == 64)


@query("SELECT CAST(k AS BIGINT) AS size, count(*) AS samples, true AS fits FROM range(100, 500, 100) r(k), range(3) s(i) GROUP BY k")
def grid_separator_study(spark, d):
    """(n, s) of thinned lattices: the largest component isn't larger than the lattice, its separator not larger than a side's few times."""
    rows = studies.grid_separators(spark, 100, 500, 3, seed=1)
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("samples"), F.min((F.col("n") <= F.col("size")) & (F.col("s") <= 3 * F.sqrt("n")) & (F.col("s") > 0)).alias("fits"))


@query("SELECT CAST(levels AS BIGINT) AS levels, CAST(width AS BIGINT) AS width, CAST(nodes AS BIGINT) AS nodes, true AS shrinks FROM (VALUES (1, 6, 36), (2, 3, 9 + 4 * 5)) t(levels, width, nodes)")
def nested_grid_study(spark, d):
    rows = studies.nested_grid_separators(spark, [(1, 6), (2, 3)], least=20).orderBy("levels", F.desc("n"))
    return rows.groupBy("levels", "width").agg(F.max("n").alias("nodes"), F.min(F.col("s") < F.col("n")).alias("shrinks"))


# generators: what must hold of their results

N = "SELECT count(*) AS n FROM embeddings"


@query("SELECT kind, CAST(n AS BIGINT) AS n, true AS inside FROM (VALUES ('disk'), ('rectangle'), ('polygon')) k(kind), (SELECT count(*) AS n FROM embeddings)")
def random_points_inside(spark, d):
    n = read_table(spark, d, "embeddings").count()
    xs, ys = (F.array(*map(F.lit, c)) for c in Q.POLYGON)
    a = generate.points_in_disk(spark, n, 2.0, 1.0, 1.0, seed=1).select(F.lit("disk").alias("kind"), "id", (dist2("x", "y", F.lit(1.0), F.lit(1.0)) <= 4).alias("ok"))
    b = generate.points_in_rectangle(spark, n, 0, 0, 2, 1, seed=1).select(F.lit("rectangle"), "id", F.col("x").between(0, 2) & F.col("y").between(0, 1))
    c = generate.points_in_polygon(spark, n, list(zip(*Q.POLYGON, strict=True)), seed=1).select(F.lit("polygon"), "id", in_polygon(F.col("x"), F.col("y"), xs, ys))
    return a.union(b).union(c).groupBy("kind").agg(F.countDistinct("id").alias("n"), F.min("ok").alias("inside"))


@query("SELECT CAST(20000 AS BIGINT) AS n, true AS centred, true AS spread")
def normal_points_moments(spark, d):
    """Mean and deviation of 20,000 draws, within five standard errors."""
    p = generate.normal_points(spark, 20_000, 3.0, -1.0, 2.0, seed=4).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev("x").alias("sx"), F.stddev("y").alias("sy"), F.corr("x", "y").alias("r"))
    return p.select("n", ((F.abs(F.col("mx") - 3) < 0.08) & (F.abs(F.col("my") + 1) < 0.08) & (F.abs("r") < 0.04)).alias("centred"), ((F.abs(F.col("sx") - 2) < 0.06) & (F.abs(F.col("sy") - 2) < 0.06)).alias("spread"))


@query(f"SELECT CAST(n AS BIGINT) AS n, true AS inside, true AS repeatable FROM ({N})")
def noise_points_inside(spark, d):
    n = read_table(spark, d, "embeddings").count()
    a, b = (cut_plan(generate.noise_points(spark, n, seed=3)) for _ in range(2))
    return yes(spark, n=a.select("id").distinct().count(), inside=a.where("x * x + y * y > 1").isEmpty(), repeatable=a.exceptAll(b).isEmpty())


@query("SELECT CAST(50 + 25 * 4 + 45 * 4 AS BIGINT) AS n, true AS inside")
def hierarchical_points_count(spark, d):
    """Half of 50 points get four each, three tenths of all 150 four more each; none is farther out than all radii together."""
    p = generate.hierarchical_points(spark, 50, [(0.5, 4, 0.1), (0.3, 4, 0.02)], seed=2)
    return p.agg(F.countDistinct("id").alias("n"), (F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))) <= 1.12).alias("inside"))


@query("SELECT kind, true AS planar, true AS connected FROM (VALUES ('delaunay'), ('rng'), ('pruned'), ('thinned')) k(kind)")
def hierarchical_graphs(spark, d):
    rows = []
    for kind in ("delaunay", "rng", "pruned", "thinned"):
        g = generate.hierarchical_graph(spark, 40, [(0.5, 4, 0.1)], kind, stretch=2.0, seed=2)
        g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
        c = stats.counts(g).first()
        rows.append((kind, c.edges <= 3 * c.nodes - 6, tied(g)))
    return spark.createDataFrame(rows, "kind string, planar boolean, connected boolean")


@query("SELECT CAST(20 + 20 * 6 AS BIGINT) AS nodes, true AS connected, true AS planar")
def hierarchical_disks_graph(spark, d):
    g = generate.hierarchical_disks(spark, [(20, 1.0), (6, 0.05)], seed=2)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    c = stats.counts(g).first()
    return yes(spark, nodes=c.nodes, connected=tied(g), planar=c.edges <= (3 * 20 - 6) + 20 * (3 * 7 - 6))


def _tree_row(spark: SparkSession, g: Graph, n: int) -> DataFrame:
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    return yes(spark, nodes=g.vertices.count(), edges=g.canonical().count(), connected=tied(g))


@query("SELECT count(*) AS nodes, count(*) - 1 AS edges, true AS connected FROM customer")
def random_tree_is_a_tree(spark, d):
    n = read_table(spark, d, "customer").count()
    return _tree_row(spark, generate.random_tree(spark, n, seed=5), n)


@query("SELECT CAST(500 AS BIGINT) AS nodes, CAST(625 AS BIGINT) AS edges, true AS connected")
def no_locality_counts(spark, d):
    return _tree_row(spark, generate.no_locality(spark, 500, 625, seed=5), 500)


@query("SELECT CAST(500 AS BIGINT) AS nodes, CAST(625 AS BIGINT) AS edges, true AS connected")
def geometric_locality_counts(spark, d):
    return _tree_row(spark, generate.geometric_locality(spark, 500, 625, seed=5), 500)


@query("SELECT rule, CAST(80 AS BIGINT) AS nodes, true AS connected, true AS near FROM (VALUES ('all'), ('hops'), ('nearest')) r(rule)")
def tree_locality_rules(spark, d):
    """Extra edges over all distances, up to four hops, and among the 20 nearest: near ones are preferred in each."""
    rows = []
    for rule, bounds in (("all", {}), ("hops", {"bound": 4}), ("nearest", {"most": 20})):
        t = generate.random_tree(spark, 80, 5)
        g = generate.tree_locality(spark, 80, 100, seed=5, **bounds)
        g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
        extra = g.canonical().select("src", "dst").join(t.canonical(), ["src", "dst"], "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("v"))
        far = trees.lca(trees.rooted(t, 0), cut_plan(extra)).agg(F.expr("percentile(distance, 0.5)").alias("m"), F.max("distance").alias("top"), F.min("distance").alias("low")).first()
        rows.append((rule, g.vertices.count(), tied(g), far.m <= 4 and far.low > 1 and (rule != "hops" or far.top <= 4)))
    return spark.createDataFrame(rows, "rule string, nodes long, connected boolean, near boolean")


@query("SELECT family, true AS planar FROM (VALUES ('grid_degrees'), ('voronoi')) f(family)")
def kernel_families_planar(spark, d):
    out = None
    for name in ("grid_degrees", "voronoi"):
        rows = generate.sampled_family(spark, name, spark.range(3).select(F.col("id").alias("run_id"), F.lit(800).cast("long").alias("size"), F.col("id").alias("seed")))
        rows = rows.agg(F.min((F.col("m") <= 3 * F.col("n") - 6) & (F.col("n") > 100)).alias("planar")).select(F.lit(name).alias("family"), "planar")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT true AS connected, true AS sparse")
def voronoi_road_network(spark, d):
    """The largest component of the cells' sides, thinned to a spanner."""
    g = generate.voronoi_road_network(spark, 600, seed=2)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    c = stats.counts(g).first()
    return yes(spark, connected=tied(g), sparse=c.nodes > 100 and c.edges <= 3 * c.nodes - 6)


@query("SELECT true AS connected, true AS larger")
def bridged_and_highway(spark, d):
    rows = []
    for name in ("bridged", "highway"):
        g = generate.kernel_graph(spark, name, 400, 3)
        g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
        c = stats.counts(g).first()
        rows.append((tied(g) or name == "highway", c.nodes >= 400 and c.edges >= c.nodes - 1))
    return yes(spark, connected=all(a for a, _ in rows), larger=all(b for _, b in rows))


@query("SELECT CAST(4 * 4 * 16 AS BIGINT) AS nodes, CAST(16 * 24 + 8 * 3 + 4 * 4 + 2 * 4 + 6 AS BIGINT) AS edges, true AS connected")
def cbrt_grid_counts(spark, d):
    """Sixteen 4x4 lattices of 24 edges; eight bridgings of two with ceil(cbrt 16) = 3 edges, four with 4, two with 4, one with ceil(cbrt 128) = 6."""
    g = generate.cbrt_grid(spark, 4, 2, seed=1)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    c = stats.counts(g).first()
    return yes(spark, nodes=c.nodes, edges=c.edges, connected=tied(g))


@query("SELECT true AS connected, true AS thin, CAST(400 AS BIGINT) AS most")
def grid_average_degree(spark, d):
    g = generate.grid_average_degree(spark, 20, 2.5, seed=3)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    c = stats.counts(g).first()
    return yes(spark, connected=tied(g), thin=c.edges <= 500 and c.nodes <= 400, most=400)


@query("SELECT true AS connected, true AS degrees")
def sparse_nested_grid_shape(spark, d):
    """A vertex has at most four edges of each of the three levels."""
    g = generate.sparse_nested_grid(spark, [5, 4], 4, seed=1)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    return yes(spark, connected=tied(g), degrees=g.degrees().where("degree NOT BETWEEN 1 AND 12").isEmpty())


@query("SELECT CAST(n AS BIGINT) AS n, true AS positive FROM (SELECT count(*) AS n FROM embeddings)")
def noise_graph_separators(spark, d):
    """The flagship chain's sizes: a separator of a part has at least one vertex and fewer than the part."""
    n = read_table(spark, d, "embeddings").count()
    g = generate.noise_graph(spark, n, seed=7)
    g = Graph(cut_plan(g.vertices), cut_plan(g.edges))
    t = separator.elimination_tree(g, separator.nested_dissection(g))
    return yes(spark, n=g.vertices.count(), positive=separator.separator_sizes(t).where("s < 1 OR s >= n").isEmpty())


# Boltzmann sampling


@query("SELECT CAST(count(*) AS BIGINT) AS trees, true AS counted, true AS near_mean, true AS capped FROM customer")
def binary_trees(spark, d):
    """Leaves are one more than nodes, colours alternate, and the mean size of trees with a black root is that of the branching process, within five standard errors; with a cap none is larger."""
    runs = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("run_id"), F.lit(11).cast("long").alias("seed"))
    p, q = 0.6, 0.55  # chances of a leaf instead of a black and of a white node
    t = cut_plan(boltzmann.sampled_trees(runs, 0.5, p, q, root="black"))
    mean = (1 + 2 * (1 - q)) / (1 - 4 * (1 - q) * (1 - p))
    shown = t.agg(F.count("nodes").alias("trees"), F.min(F.col("mixed") & (F.col("leaves") == F.col("nodes") + 1) & (F.col("black") + F.col("white") == F.col("nodes"))).alias("counted"), F.avg("nodes").alias("mean"), (F.stddev("nodes") / F.sqrt(F.count("nodes"))).alias("error"))
    most = boltzmann.sampled_trees(runs, 0.5, p, q, root="black", most=5).join(t.select("run_id", F.col("nodes").alias("whole")), "run_id")
    capped = most.agg(F.min((F.col("whole") <= 5).eqNullSafe(F.col("nodes").isNotNull())).alias("capped"))
    return shown.crossJoin(capped).select("trees", "counted", (F.abs(F.col("mean") - mean) < 5 * F.col("error")).alias("near_mean"), "capped")


@query("SELECT CASE WHEN v < 9 THEN 'binary trees' ELSE '3-connected networks' END AS section, CAST(CASE WHEN v < 9 THEN v ELSE v - 9 END AS INTEGER) AS vector, k, (v + k / 4.0)::DOUBLE AS value FROM (SELECT n_nationkey AS v, unnest([0, 1]) AS k FROM nation WHERE n_nationkey < 12)")
def coefficients_round_trip(spark, d):
    """A table of two cases with a vector for each nation; the second is read."""
    at = place(spark)
    n = nations(spark, d)
    lines = n.where("id < 12").select((F.col("id") * 2 + 102).alias("k"), F.format_string("%s %s", F.col("id").cast("double").cast("string"), (F.col("id") + 0.25).cast("string")).alias("line"))
    heads = spark.createDataFrame([(0, "#sections"), (1, ""), (2, "case10"), (3, "0.5"), (4, ""), (100, "case20"), (101, ""), (900, "case30"), (901, "0.75")], "k long, line string")
    blanks = n.where("id < 12").select((F.col("id") * 2 + 103).alias("k"), F.lit("").alias("line"))
    lines.union(heads).union(blanks).coalesce(1).orderBy("k").select("line").coalesce(1).write.text(at)
    return boltzmann.read_coefficients(spark, at, 20)
