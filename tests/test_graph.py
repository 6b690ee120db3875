"""Fixtures with values worked out by hand, invariants of generators, kernels against brute force, and file round trips."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isthmus.operators import components, diameter, disk, planar, proximity, separator, spanner, stats, traverse, trees
from isthmus.operators.graph import Graph, numbered, running
from isthmus.operators.mst import spanning_forest
from isthmus.operators.triangulate import Triangulation, in_circle
from isthmus.plans import catalogue
from isthmus.sources import examples, formats, generate, kernels


def edges(df):
    return {(r.src, r.dst) for r in df.collect()}


def path_graph(spark, n):
    return Graph.from_edges(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def test_square(spark):
    g = examples.c4(spark)
    assert {r.d for r in traverse.multi_target_hops(g, 0, spark.createDataFrame([(1,), (2,)], "id long")).collect()} == {1, 2}
    q = spark.createDataFrame([(0, 0, 2, 1.4), (1, 0, 2, 2.00001), (2, 0, 2, 2.0), (3, 1, 1, 0.0)], "qid long, u long, v long, bound double")
    assert [r.within for r in traverse.within_distance(g.weighted(), q).orderBy("qid").collect()] == [False, True, False, True]
    assert stats.counts(g).first()["meshedness"] == pytest.approx(1 / 3)
    assert edges(components.contract_degree2(g).canonical()) == {(2, 3)}
    order = spark.createDataFrame([(0, 0), (2, 1), (1, 2), (3, 3)], "node long, rank long")
    t = separator.elimination_tree(g, order)
    assert {r.id: r.parent for r in t.collect()} == {0: 1, 2: 1, 1: 3, 3: None}
    assert {r.id: r["size"] for r in trees.subtree_sizes(t.select("id", "parent")).collect()} == {0: 1, 2: 1, 1: 3, 3: 4}
    assert separator.separator_sizes(t).count() == 0
    assert [r.node for r in separator.top_level_separator(t).orderBy("step").collect()] == [3, 1]


def test_lollipop(spark):
    g = examples.lollipop(spark)
    assert stats.counts(g).first()["edges"] == 10 and stats.counts(g).first()["meshedness"] == pytest.approx(2 / 13)
    assert {r.id: r.d for r in traverse.bfs(g, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5, 8: 4}
    assert {r.degree: r.frac for r in stats.degree_distribution(g).where("cnt > 0").collect()} == {2: pytest.approx(7 / 9), 3: pytest.approx(2 / 9)}
    assert diameter.all_bfs_diameter(g) == 6 and diameter.double_sweep(g, 0).first()["d"] == 6


def test_disconnected(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (1, 0), (5, 5)], "src long, dst long"), spark.range(6))
    assert components.component_sizes(g).count() == 4 and not components.is_connected(g)
    assert {r.degree: r.cnt for r in stats.degree_distribution(g).collect()} == {0: 3, 1: 0, 2: 3}
    assert diameter.all_bfs_diameter(g) is None
    assert {r.id for r in components.largest_component(g).vertices.collect()} == {0, 1, 2}
    p = path_graph(spark, 5)
    parts = components.components_minus_separator(p, spark.createDataFrame([(2,)], "id long"))
    assert {(r.id, r.component) for r in parts.collect()} == {(0, 0), (1, 0), (3, 3), (4, 3)}
    e = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert components.connected_components(e).count() == 0 and not spanning_forest(e.edges.withColumn("w", F.lit(1.0))).count()


def test_long_path_settles(spark):
    p = path_graph(spark, 300)
    assert components.connected_components(p).select("component").distinct().count() == 1
    tree = p.vertices.select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert trees.depths(tree).agg(F.max("depth")).first()[0] == 299
    got = trees.lca(tree, spark.createDataFrame([(10, 250), (7, 7)], "u long, v long")).collect()
    assert {(r.u, r.v): (r.lca, r.distance) for r in got} == {(10, 250): (10, 240), (7, 7): (7, 0)}


def test_mst_of_coordinates(spark):
    g = Graph.from_coordinate_edges(spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 2.0, 0.0), (0.0, 1.0, 2.0, 3.0), (2.0, 0.0, 2.0, 3.0)], "ux double, uy double, vx double, vy double"))
    f = spanning_forest(g.edge_lengths())
    assert g.vertices.count() == 4 and f.count() == 3 and f.agg(F.sum("w")).first()[0] == pytest.approx(5.828427)


def test_numbering_and_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    keys = sorted(r.k for r in rows.collect())
    assert [r.n for r in numbered(rows, ["k"], "n").orderBy("k").collect()] == list(range(1000))
    assert [r.s for r in running(rows, ["k"], "k", "s").orderBy("k").collect()] == list(itertools.accumulate(keys))


def test_crossings(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 1.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, 2.0, 0.0), (5, 2.0, 1.0)], "id long, x double, y double")
    g = planar.planarize(Graph.from_edges(spark.createDataFrame([(0, 1), (2, 3), (4, 5), (0, 2)], "src long, dst long"), v))
    assert edges(g.canonical()) == {(0, 6), (6, 7), (1, 7), (2, 6), (3, 6), (4, 7), (5, 7), (0, 2)}
    at = {r.id: (r.x, r.y) for r in g.vertices.collect()}
    assert at[6] == (1.0, pytest.approx(1 / 3)) and at[7] == (2.0, pytest.approx(2 / 3))


def test_histogram(spark):
    h = stats.histogram(spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 2, 3, 4, 4, 5)], "v double"), "v", [0.0, 1.0, 2.0, 3.0, 4.0])
    assert [r.cnt for r in h.orderBy("bin").collect()] == [2, 2, 1, 2]
    assert stats.bin_edges(4, 4) == pytest.approx([0, 1.00000025, 2.0000005, 3.00000075, 4.000001])


def test_triangulation_is_delaunay():
    rng = np.random.default_rng(1)
    for x, y in ((rng.random(50), rng.random(50)), (rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)), (np.arange(5.0), np.arange(5.0))):
        t = Triangulation(x, y)
        for a, b, c in t.triangles():
            assert all(in_circle(x[a], y[a], x[b], y[b], x[c], y[c], x[p], y[p]) <= 0 for p in range(len(x)))
        assert len(t.edges()) >= len(set(zip(x, y, strict=True))) - 1


def test_proximity_chain_and_tiles(spark):
    p = generate.points_in_rectangle(spark, 400, 0, 0, 1, 1, seed=3)
    dt = edges(proximity.delaunay_edges(p))
    assert dt == edges(proximity.delaunay_edges(p, tile_points=40)) and len(dt) <= 3 * 400 - 6
    d = spark.createDataFrame(sorted(dt), "src long, dst long")
    gg, ref, rng = edges(proximity.gabriel_edges(p, d)), edges(proximity.rng_edges(p, d)), edges(proximity.rng_edges(p, d, "all"))
    tree = edges(spanning_forest(proximity.with_points(d, p).select("src", "dst", F.sqrt("d2").alias("w"))))
    assert tree <= rng <= ref <= dt and rng <= gg <= dt and len(tree) == 399


def brute_cut(adj, sources, sinks):
    n = len(adj)
    for k in range(n + 1):
        for cut in itertools.combinations(range(n), k):
            seen = {s for s in sources if s not in cut}
            queue = list(seen)
            for v in queue:
                for w in adj[v]:
                    if w not in seen and w not in cut:
                        seen.add(w)
                        queue.append(w)
            if not seen & set(sinks):
                return k
    return n


def test_vertex_cuts_are_least():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(4, 9)
        adj = [[] for _ in range(n)]
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.45:
                adj[a].append(b)
                adj[b].append(a)
        s, t = [0, 1], [n - 1, n - 2]
        cut = separator.min_vertex_cut(adj, s, t)
        assert len(cut) == brute_cut(adj, s, t)


def brute_tree(n, pairs, rank):
    order = sorted(range(n), key=rank.__getitem__)
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    parent = {}
    for v in order:
        up = sorted((w for w in near[v] if rank[w] > rank[v]), key=rank.__getitem__)
        parent[v] = up[0] if up else None
        for w in up[1:]:
            near[up[0]].add(w)
            near[w].add(up[0])
    return parent


def test_elimination_tree_is_that_of_the_filled_graph(spark):
    rng = random.Random(8)
    n = 40
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(55)})
    rank = list(range(n))
    rng.shuffle(rank)
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), spark.range(n))
    t = separator.elimination_tree(g, spark.createDataFrame(list(enumerate(rank)), "node long, rank long"))
    assert {r.id: r.parent for r in t.collect()} == brute_tree(n, pairs, rank)


def test_nested_dissection_is_an_order(spark):
    g = generate.lattice(spark, 10)
    rows = separator.nested_dissection(g, leaf=10).collect()
    assert sorted(r.node for r in rows) == list(range(100)) and sorted(r.rank for r in rows) == list(range(100))
    s = separator.node_separator(g).select("id")
    left = components.components_minus_separator(g, s).groupBy("component").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert left[1] >= 2 and left[0] <= 70


def test_lattice_separators():
    rank = catalogue.lat_rank(5)
    assert rank[22] == 24 and sorted(rank.values()) == list(range(25))


def test_spanners(spark):
    p = generate.points_in_rectangle(spark, 60, 0, 0, 1, 1, seed=4)
    g = Graph.from_edges(proximity.delaunay_edges(p), p)
    for ascending in (False, True):
        kept = edges(spanner.greedy_spanner(g, 2.0, ascending).canonical())
        w = {(r.src, r.dst): r.w for r in g.edge_lengths().collect()}
        adj = {v: {} for v in range(60)}
        for a, b in kept:
            adj[a][b] = adj[b][a] = w[a, b]
        if ascending:
            assert all(spanner.shorter_path(adj, a, b, d * 2.0 + 1e-9) for (a, b), d in w.items())
    pruned = spanner.prune_detours(g, 2.0)
    assert edges(pruned.canonical()) <= edges(g.canonical()) and components.is_connected(Graph(pruned.vertices, pruned.edges.select("src", "dst")))


def test_deterministic_generators(spark):
    assert [len(kernels.nested_grid(w, k)[0]) for w, k in ((3, 1), (3, 2), (4, 2), (4, 3))] == [9, 29, 124, 1096]
    assert [(n, len(e)) for n, e in map(kernels.cbrt_maximal, (2, 3, 10, 100, 2000))] == [(1, 0), (3, 2), (8, 17), (82, 808), (1482, 63802)]
    assert kernels.super_grid_width(16, 5) == 5 and kernels.super_grid_width(9, 2) == 3
    assert edges(generate.lattice(spark, 4).canonical()) == {(i, j) for i in range(16) for j in (i + 1, i + 4) if j < 16 and (j == i + 4 or j % 4)}


def test_random_generators(spark):
    t = kernels.prufer_tree(100, 1)
    assert len(t) == 99 and {x for e in t for x in e} == set(range(100))
    a = generate.points_in_disk(spark, 500, seed=9)
    assert a.repartition(5).orderBy("id").collect() == a.orderBy("id").collect() and a.where("x * x + y * y > 1").isEmpty()
    for name, make in kernels.FAMILIES.items():
        points, e = make(300, 2)
        assert len(e) == len({tuple(sorted(x)) for x in e}) and make(300, 2)[1] == e, name
    g = generate.sparse_nested_grid(spark, [5], 4, seed=1)
    assert components.is_connected(g)


def test_file_round_trips(spark, tmp_path):
    g = examples.c4(spark)
    formats.write_csr(g, f"{tmp_path}/csr")
    h = formats.read_csr(spark, f"{tmp_path}/csr", positions=True)
    assert edges(h.edges) == edges(g.edges) and {(r.id, r.x, r.y) for r in h.vertices.collect()} == {(r.id, r.x, r.y) for r in g.vertices.collect()}
    formats.write_metis(g, f"{tmp_path}/m")
    formats.write_pace(g, f"{tmp_path}/p")
    assert edges(formats.read_metis(spark, f"{tmp_path}/m").edges) == edges(formats.read_pace(spark, f"{tmp_path}/p").edges) == edges(g.edges)
    formats.write_pigale(g, f"{tmp_path}/pig")
    assert edges(formats.read_edge_list(spark, f"{tmp_path}/pig", base=1, drop_trailer=True)) == edges(g.canonical())
    (tmp_path / "e").write_text("header\n0 1\nbad\n1 2 9\n")
    assert edges(formats.read_edge_list(spark, f"{tmp_path}/e")) == {(0, 1), (1, 2)}
    (tmp_path / "xy").write_text("1.5,2\nx\n3,4\n")
    assert [(r.id, r.x, r.y) for r in formats.read_points(spark, f"{tmp_path}/xy").orderBy("id").collect()] == [(0, 1.5, 2.0), (1, 3.0, 4.0)]
    (tmp_path / "o").write_text("2\n3\n1\n")
    assert {(r.node, r.rank) for r in formats.read_order(spark, f"{tmp_path}/o").collect()} == {(0, 1), (1, 2), (2, 0)}


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1.5" lon="2.5"/><node id="2" lat="1.6" lon="2.6"><tag k="a" v="b"/></node><node id="3" lat="0" lon="0"/><way id="9"><nd ref="1"/><nd ref="2"/></way></osm>')
    g = formats.read_osm(spark, f"{tmp_path}/a.osm")
    assert {(r.id, r.x, r.y) for r in g.vertices.collect()} == {(1, 2.5, 1.5), (2, 2.6, 1.6)} and edges(g.canonical()) == {(1, 2)}


def test_entry_works_without_the_training_data_package(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("isthmus.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "isthmus.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "degree_cdf" in entry.queries() and not any(k.startswith("op1") for k in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def clumped(spark, n, seed):
    """Points with copies, a dense clump and lone ones."""
    rng = np.random.default_rng(seed)
    xy = np.round(np.r_[rng.normal(0, 0.05, (n, 2)), rng.uniform(-1, 1, (n // 4, 2)), np.full((5, 2), 0.01)], 3)
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


def test_searches_without_stored_edges(spark, monkeypatch):
    p = clumped(spark, 120, 3).localCheckpoint()
    stored = Graph.from_edges(proximity.unit_disk_edges(p, 0.1), p).weighted()
    sources = spark.createDataFrame([(0,), (7,), (130,)], "id long")
    known = {(r.source, r.id): r.d for r in traverse.multi_sssp(stored, sources).collect()}
    far = max((d, i) for (s, i), d in known.items() if s == 0)
    monkeypatch.setattr(disk.DiskGraph, "edges", property(lambda self: pytest.fail("edges are asked for")))
    g = disk.DiskGraph(p, 0.1)
    found = {(r.source, r.id): r.d for r in traverse.multi_sssp(g, sources).collect()}
    assert found.keys() == known.keys() and all(found[k] == pytest.approx(known[k], abs=1e-12) for k in known)
    row = traverse.shortest_distance(g, 0, far[1]).first()
    assert (row.source, row.target) == (0, far[1]) and row.d == pytest.approx(far[0])
    near = {(r.source, r.id) for r in traverse.multi_sssp(g, sources, limit=0.15).collect()}
    assert near == {k for k, d in known.items() if d < 0.15}


@pytest.mark.parametrize(("reach", "stretch", "ignore_edge", "inclusive"), [(0.2, 1.2, False, True), (0.1, 1.5, True, False), (0.17, 2.2, True, False), (0.1, 1.0, False, False)])
def test_stretches_without_stored_paths(spark, reach, stretch, ignore_edge, inclusive):
    p = clumped(spark, 60, 5).localCheckpoint()
    stored = Graph.from_edges(proximity.unit_disk_edges(p, 0.1), p).weighted()
    rows = p.collect()
    pairs = [(a.id, b.id, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) for a in rows for b in rows if a.id < b.id]
    asked = [(k, u, v, d2**0.5 * stretch) for k, (u, v, d2) in enumerate(x for x in pairs if (x[2] <= reach * reach if inclusive else x[2] < reach * reach))]
    known = {r.qid: r.within for r in traverse.within_distance(Graph(stored.vertices, stored.edges.localCheckpoint()), spark.createDataFrame(asked, "qid long, u long, v long, bound double"), ignore_edge=ignore_edge).collect()}
    found = [(r.u, v, t) for r in disk.stretches(disk.DiskGraph(p, 0.1), reach, stretch, ignore_edge, inclusive).collect() for v, t in zip(r.near, r.within, strict=True)]
    assert sorted(found) == [(u, v, known[k]) for k, u, v, _ in asked]


def test_stretches_on_a_line(spark):
    """Points 0.03 apart, so that steps of two are edges: by hand."""
    p = spark.createDataFrame([(i, 0.03 * i, 0.0) for i in range(6)], "id long, x double, y double")
    rows = {r.u: dict(zip(r.near, r.within, strict=True)) for r in disk.stretches(disk.DiskGraph(p, 0.07), 0.1, 1.5, ignore_edge=True).collect()}
    assert rows[0] == {1: False, 2: True, 3: True} and rows[4] == {5: False}


def test_parts_taken_apart_in_one_task(spark):
    """The same order, separators and levels as by rounds over all parts."""
    p = clumped(spark, 150, 9).dropDuplicates(["x", "y"]).localCheckpoint()
    g = Graph.from_edges(proximity.delaunay_edges(p).localCheckpoint(), p)
    g = Graph(g.vertices, g.edges.localCheckpoint())
    by = [[tuple(r) for r in separator.nested_dissection(g, leaf=12, whole=w).orderBy("rank").collect()] for w in (0, 60, 1000)]
    assert by[0] == by[1] == by[2] and len(by[0]) == p.count()
    by = [sorted(tuple(r) for r in separator.separate_recursively(g, 20, whole=w).collect()) for w in (0, 60, 1000)]
    assert by[0] == by[1] == by[2] and len(by[0]) > 3


def test_separator_of_a_large_triangulation():
    """8,000 points: searches for one path at a time took many times as long."""
    xy = np.random.default_rng(4).normal(0, 0.1, (8000, 2))
    adj = [[] for _ in xy]
    for a, b in Triangulation(xy[:, 0], xy[:, 1]).edges():
        adj[a].append(int(b))
        adj[b].append(int(a))
    began = time.process_time()
    cut = separator.inertial_separator(adj, xy)
    took = time.process_time() - began
    parts = separator._parts_without(adj, set(cut))
    assert len(parts) > 1 and max(map(len, parts)) <= 0.67 * len(xy) and len(cut) < 4 * len(xy) ** 0.5
    assert took < 4


def test_edge_lengths_of_disks(spark, tmp_path):
    """The same file, copies of points among them, as by rows of stored edges."""
    p = clumped(spark, 100, 11).localCheckpoint()
    g = Graph.from_edges(proximity.unit_disk_edges(p, 0.1), p)
    formats.write_edge_lengths(g, str(tmp_path / "a"))
    formats.write_edge_lengths(disk.DiskGraph(p, 0.1), str(tmp_path / "b"))
    assert (tmp_path / "a").read_text() == (tmp_path / "b").read_text() != ""
    assert {r.id: r.degree for r in g.degrees().collect()} == {r.id: r.degree for r in disk.DiskGraph(p, 0.1).degrees().collect()}


def test_csr_of_disks(spark, tmp_path):
    """The same files as by stored edges, and the same edges read back."""
    p = clumped(spark, 100, 13).withColumn("id", F.col("id") * 3 + 1).localCheckpoint()
    g = Graph.from_edges(proximity.unit_disk_edges(p, 0.1), p)
    formats.write_csr(g, str(tmp_path / "a"))
    formats.write_csr(disk.DiskGraph(p, 0.1), str(tmp_path / "b"))
    for name in ("first_out", "head", "latitude", "longitude"):
        assert (tmp_path / "a" / name).read_bytes() == (tmp_path / "b" / name).read_bytes() != b""
    assert edges(formats.read_csr(spark, str(tmp_path / "b")).edges) == edges(g.reindex()[0].edges)


def test_csr_records(spark, tmp_path):
    """Numbers of heads that nothing divides, vertices over several records, and repeated edges."""
    heads = np.r_[np.arange(9000), [5, 5, 3], np.arange(1004)].astype("<u4")  # 10,007 is prime
    heads.tofile(tmp_path / "head")
    np.array([0, 0, 9000, 9003, 9003, 10007], "<u4").tofile(tmp_path / "first_out")
    assert formats._records(spark, str(tmp_path / "head"), 4, 10007)[1] >= 256
    assert [r.value for r in formats.read_binary_vector(spark, str(tmp_path / "head")).orderBy("pos").collect()] == heads.tolist()
    rows = [tuple(r) for r in formats.read_csr(spark, str(tmp_path)).edges.collect()]
    assert sorted(rows) == [(1, i) for i in range(9000)] + [(2, 3), (2, 5)] + [(4, i) for i in range(1004)]
