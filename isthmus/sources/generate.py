"""Seeded generators. Random numbers are hashes of (seed, id, draw), so results don't depend on partitioning.

Point sets and lattices are expressions over `range`; generators that are sequential by nature are kernels, one per
sample, and run in parallel over samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import in_polygon, uniform
from ..operators.components import largest_component
from ..operators.graph import Graph, swapped
from ..operators.mst import spanning_forest
from ..operators.proximity import delaunay_edges, rng_edges, with_points
from ..operators.spatial import radius_join
from ..operators.spanner import greedy_spanner, prune_detours
from ..runtime import cut_plan
from . import kernels
from .kernels import super_grid_width

# points


def _u(seed: int, draw: int) -> Column:
    return uniform(seed, "id", draw=draw)


def points_in_disk(spark: SparkSession, n: int, radius: float = 1.0, cx: float = 0.0, cy: float = 0.0, seed: int = 0) -> DataFrame:
    """n points (id, x, y), uniform on a disk: r = R sqrt(u)."""
    r, a = radius * F.sqrt(_u(seed, 0)), 2 * math.pi * _u(seed, 1)
    return spark.range(n).select("id", (cx + r * F.cos(a)).alias("x"), (cy + r * F.sin(a)).alias("y"))


def points_in_rectangle(spark: SparkSession, n: int, x0: float, y0: float, x1: float, y1: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (x0 + (x1 - x0) * _u(seed, 0)).alias("x"), (y0 + (y1 - y0) * _u(seed, 1)).alias("y"))


def normal_points(spark: SparkSession, n: int, cx: float = 0.0, cy: float = 0.0, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Independent normal coordinates, by Box and Muller."""
    r, a = sigma * F.sqrt(-2 * F.log(1 - _u(seed, 0))), 2 * math.pi * _u(seed, 1)
    return spark.range(n).select("id", (cx + r * F.cos(a)).alias("x"), (cy + r * F.sin(a)).alias("y"))


def points_in_polygon(spark: SparkSession, n: int, corners: list[tuple[float, float]], seed: int = 0, tries: int = 1000) -> DataFrame:
    """n points in a polygon: the first of up to `tries` draws in its box that falls inside, else the mean corner."""
    xs, ys = [float(c[0]) for c in corners], [float(c[1]) for c in corners]
    x = lambda k: F.lit(min(xs)) + (max(xs) - min(xs)) * F.xxhash64(F.lit(seed), F.lit(0), "id", k).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    y = lambda k: F.lit(min(ys)) + (max(ys) - min(ys)) * F.xxhash64(F.lit(seed), F.lit(1), "id", k).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    ax, ay = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    # few tries come first, so that most points cost few draws
    pick = lambda lo, hi: F.get(F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: in_polygon(x(k), y(k), ax, ay)), F.lit(0))
    t = spark.range(n).withColumn("k", F.coalesce(pick(0, min(15, tries - 1)), *([pick(16, tries - 1)] if tries > 16 else [])))
    return t.select("id", F.when(F.col("k").isNull(), sum(xs) / len(xs)).otherwise(x(F.col("k"))).alias("x"), F.when(F.col("k").isNull(), sum(ys) / len(ys)).otherwise(y(F.col("k"))).alias("y"))


def hierarchical_points(spark: SparkSession, n: int, levels: list[tuple[float, int, float]], radius: float = 1.0, seed: int = 0) -> DataFrame:
    """Start with n points on a disk; level (fraction, k, r) chooses that fraction of all points so far and adds k points within r of each."""
    out = points_in_disk(spark, n, radius, seed=seed)
    size = n
    for level, (fraction, k, r) in enumerate(levels, 1):
        m = int(size * fraction)
        chosen = out.withColumn("o", uniform(seed + level, "id")).orderBy("o", "id").limit(m).select("id", "x", "y")
        slot = chosen.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        d, a = r * F.sqrt(uniform(seed + level, "id", "i", draw=1)), 2 * math.pi * uniform(seed + level, "id", "i", draw=2)
        # ids: level in front of the centre's id and the slot, so that they need no global numbering
        new = slot.select((F.xxhash64(F.lit(level), "id", "i").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 61)).alias("id"), (F.col("x") + d * F.cos(a)).alias("x"), (F.col("y") + d * F.sin(a)).alias("y"))
        out = cut_plan(out.union(new))
        size += m * k
    return out


def noise_points(spark: SparkSession, n: int, scales: list[float] | None = None, seed: int = 0, corners: list[tuple[float, float]] | None = None, batch: int | None = None) -> DataFrame:
    """n points on the unit disk (or in a polygon), accepted where a product of Perlin octaves is large: candidates by id, the first n accepted."""
    scales = scales or [4.0 * 2**k for k in range(11)]
    size = batch or 64 * n
    found, start = None, 0
    while True:
        c = spark.range(start, start + size)
        r, a = F.sqrt(_u(seed, 0)), 2 * math.pi * _u(seed, 1)
        c = c.select("id", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))
        if corners:
            c = points_in_polygon(spark, size, corners, seed + start).withColumn("id", F.col("id") + start)
        kept = cut_plan(c.where(kernels.noise_accepts(F.col("x"), F.col("y"), uniform(seed, "id", draw=2), scales, seed)))
        found = kept if found is None else found.union(kept)
        if found.count() >= n:
            return found.orderBy("id").limit(n)
        start += size


# lattices and nested grids


def lattice(spark: SparkSession, k: int) -> Graph:
    """k x k grid graph; id = i k + j at (i, j)."""
    v = spark.range(k * k).select("id", F.floor(F.col("id") / k).cast("double").alias("x"), (F.col("id") % k).cast("double").alias("y"))
    right = v.where(F.col("id") % k < k - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = v.where(F.col("id") < k * (k - 1)).select(F.col("id").alias("src"), (F.col("id") + k).alias("dst"))
    e = right.union(down)
    return Graph(v, e.union(swapped(e)))


def grid_average_degree(spark: SparkSession, k: int, degree: float, seed: int = 0) -> Graph:
    return largest_component(lattice(spark, k).enforce_average_degree(degree, seed))


def nested_grid(spark: SparkSession, width: int, levels: int) -> Graph:
    """A width x width grid whose cells hold further grids, levels deep, each placed by bilinear interpolation of its cell.

    A refined cell's grid is built on the cell's own four corners, which are its corner vertices; its other vertices are
    its own, so neighbouring cells don't share those on their common side.
    """
    v, e = kernels.nested_grid(width, levels)
    return Graph.from_edges(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame(v, "id long, x double, y double"))


def cbrt_maximal(spark: SparkSession, n: int) -> Graph:
    """Complete graphs of floor(cbrt n) vertices joined to all of two recursive halves of the rest."""
    m, e = kernels.cbrt_maximal(n)
    return Graph.from_edges(spark.createDataFrame(e, "src long, dst long") if e else spark.createDataFrame([], "src long, dst long"), spark.range(m))


def base_lattice(spark: SparkSession, lo: tuple[int, int], hi: tuple[int, int], step: int) -> DataFrame:
    """Coordinate edges (ux, uy, vx, vy) of the lattice with the given spacing between two corners, ends included."""
    span = lambda a, b, name: spark.range(a, b + 1, step).withColumnRenamed("id", name)
    at = span(lo[0], hi[0], "ux").crossJoin(span(lo[1], hi[1], "uy"))
    along = at.where(F.col("ux") + step <= hi[0]).select("ux", "uy", (F.col("ux") + step).alias("vx"), F.col("uy").alias("vy"))
    up = at.where(F.col("uy") + step <= hi[1]).select("ux", "uy", F.col("ux").alias("vx"), (F.col("uy") + step).alias("vy"))
    return along.union(up)


def sparse_nested_grid(spark: SparkSession, counts: list[int], bottom_width: int, seed: int = 0) -> Graph:
    """Lattices within cells of lattices: counts[k] random cells of each lattice of level k + 1 hold one of level k each.

    The lowest level's lattices are bottom_width wide; the width above is such that its cube is about the number of
    vertices. All levels share one integer grid, so vertices with equal coordinates are one.
    """
    widths, sizes = [bottom_width], [bottom_width**2]
    for c in counts:
        widths.append(super_grid_width(sizes[-1], c))
        sizes.append(c * sizes[-1] + widths[-1] ** 2)
    side = 1
    for w in widths:
        side *= w - 1
    cells = spark.createDataFrame([(0, 0)], "x long, y long")
    edges = None
    for level in range(len(widths) - 1, -1, -1):
        w = widths[level]
        step = side // (w - 1)
        at = cells.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("i")).select("x", "y", "i", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("j"))
        px, py = F.col("x") + F.col("i") * step, F.col("y") + F.col("j") * step
        right = at.where(F.col("i") < w - 1).select(px.alias("ux"), py.alias("uy"), (px + step).alias("vx"), py.alias("vy"))
        up = at.where(F.col("j") < w - 1).select(px.alias("ux"), py.alias("uy"), px.alias("vx"), (py + step).alias("vy"))
        edges = right.union(up) if edges is None else edges.union(right).union(up)
        if level:
            order = Window.partitionBy("x", "y").orderBy(uniform(seed + level, "x", "y", "i", "j"), "i", "j")
            chosen = at.where((F.col("i") < w - 1) & (F.col("j") < w - 1)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= counts[level - 1])
            cells = cut_plan(chosen.select(px.alias("x"), py.alias("y")))
        side = step
    return Graph.from_coordinate_edges(cut_plan(edges))


def cbrt_grid(spark: SparkSession, block: int, doublings: int, seed: int = 0) -> Graph:
    """A block x block lattice, doubled side by side again and again in turn along x and y; each time ceil(cbrt n) random border pairs are bridged."""
    g = lattice(spark, block)
    w = h = block
    for k in range(2 * doublings):
        n = w * h
        across = k % 2 == 0
        shift = F.struct((F.col("x") + (w if across else 0)).alias("x"), (F.col("y") + (0 if across else h)).alias("y"))
        other = g.vertices.select((F.col("id") + n).alias("id"), shift["x"].alias("x"), shift["y"].alias("y"))
        side = (F.col("x") == w - 1) if across else (F.col("y") == h - 1)
        border = g.vertices.where(side).select("id", "x", "y", uniform(seed + k, "id").alias("u")).orderBy("u", "id").limit(max(1, math.ceil(round(n ** (1 / 3), 9))))
        far = other.select(F.col("id").alias("dst"), F.col("x").alias("fx"), F.col("y").alias("fy"))
        bridge = border.join(far, (F.col("fx") == F.col("x") + (1 if across else 0)) & (F.col("fy") == F.col("y") + (0 if across else 1))).select(F.col("id").alias("src"), "dst")
        copy = g.edges.select(F.col("src") + n, F.col("dst") + n)
        g = Graph(cut_plan(g.vertices.union(other)), cut_plan(g.edges.select("src", "dst").union(copy).union(bridge).union(swapped(bridge))))
        w, h = (2 * w, h) if across else (w, 2 * h)
    return g


# random trees and locality


def random_tree(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """A uniform random labelled tree: a random Prüfer sequence decoded (one kernel, linear in n)."""
    e = kernels.prufer_tree(n, seed)
    return Graph.from_edges(spark.createDataFrame(e, "src long, dst long") if e else spark.createDataFrame([], "src long, dst long"), spark.range(n))


def _extra_pairs(g: Graph, wanted: int, seed: int) -> DataFrame:
    """`wanted` random pairs of vertices 0..n-1 that aren't edges yet."""
    n = g.vertices.count()
    draws = g.vertices.sparkSession.range(2 * wanted + 64)
    at = lambda k: F.floor(uniform(seed, "id", draw=k) * n).cast("long")
    pairs = draws.select("id", at(0).alias("a"), at(1).alias("b")).where("a <> b").select("id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.min("id").alias("id")).join(g.edges, ["src", "dst"], "left_anti").orderBy("id").limit(wanted).select("src", "dst")


def no_locality(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """A random tree and uniform extra edges up to m."""
    t = random_tree(spark, n, seed)
    return t.add_edges(cut_plan(_extra_pairs(t, m - (n - 1), seed + 1)))


def tree_locality(spark: SparkSession, n: int, m: int, seed: int = 0, power: float = -3.0, bound: int | None = None, most: int | None = None) -> Graph:
    """A random tree and extra edges u-v for random u, v drawn with weight (tree distance)^power over distances above 1, up to `bound` hops, or among the `most` vertices nearest to u (ties by id); repeats are drawn once, so m is an upper limit.

    Hops in a tree are the distances through lowest common ancestors.

    A weighted draw is the least exponential race: min of -ln(u) / weight over the candidates, all sources at once.
    """
    from ..operators.traverse import multi_bfs

    t = random_tree(spark, n, seed)
    t = Graph(cut_plan(t.vertices), cut_plan(t.edges))
    k = m - (n - 1)
    starts = spark.range(k).select(F.col("id").alias("draw"), F.floor(uniform(seed + 1, "id") * n).cast("long").alias("source"))
    d = multi_bfs(t, starts.select(F.col("source").alias("id")).distinct(), max_hops=bound)
    if most is not None:
        d = d.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("d", "id"))).where(F.col("turn") <= most)
    d = d.where("d > 1")
    race = starts.join(d, "source").withColumn("key", -F.log(1 - uniform(seed + 2, "draw", "id")) / F.pow(F.col("d").cast("double"), F.lit(power)))
    best = race.groupBy("draw", "source").agg(F.min(F.struct("key", "id")).alias("b")).select(F.col("source").alias("src"), F.col("b.id").alias("dst"))
    return t.add_edges(cut_plan(best.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()))


def geometric_locality(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """Euclidean spanning tree of random points and random extra pairs no farther apart than its longest edge, up to m."""
    p = cut_plan(points_in_rectangle(spark, n, 0, 0, 1, 1, seed))
    tree = cut_plan(spanning_forest(with_points(delaunay_edges(p), p).select("src", "dst", F.sqrt("d2").alias("w"))))
    longest = tree.agg(F.max("w")).first()[0] or 0.0
    near = radius_join(p, p, longest).where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst")).join(tree, ["src", "dst"], "left_anti")
    extra = near.withColumn("o", uniform(seed + 1, "src", "dst")).orderBy("o", "src", "dst").limit(max(0, m - (n - 1))).select("src", "dst")
    return Graph.from_edges(cut_plan(tree.select("src", "dst").union(extra)), p)


def spatial_tree_3d(spark: SparkSession, n: int, factor: float = 1.25, seed: int = 0) -> Graph:
    """Spanning forest of random points in the unit cube over pairs within twice the expected longest tree edge, and random further such pairs up to floor(factor n) edges."""
    p = spark.range(n).select("id", _u(seed, 0).alias("x"), _u(seed, 1).alias("y"), _u(seed, 2).alias("z"))
    r = 2 * (math.log(max(n, 2)) / (4 / 3 * math.pi * max(n, 2))) ** (1 / 3)
    pairs = cut_plan(radius_join(p, p, r, ("x", "y", "z")).where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.sqrt("d2").alias("w")))
    tree = cut_plan(spanning_forest(pairs))
    extra = pairs.join(tree, ["src", "dst"], "left_anti").withColumn("o", uniform(seed + 1, "src", "dst")).orderBy("o", "src", "dst").limit(max(0, int(factor * n) - tree.count())).select("src", "dst")
    return Graph.from_edges(cut_plan(tree.select("src", "dst").union(extra)), p)


# families that combine these


def noise_graph(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """Relative-neighbour graph (Delaunay witnesses) of noise points."""
    p = cut_plan(noise_points(spark, n, seed=seed))
    return Graph.from_edges(rng_edges(p), p)


def hierarchical_graph(spark: SparkSession, n: int, levels: list[tuple[float, int, float]], kind: str = "delaunay", stretch: float = 4.0, degree: float = 2.5, seed: int = 0) -> Graph:
    """Delaunay, rng, pruned (detours) or thinned (random edges) graph of hierarchical points."""
    p = cut_plan(hierarchical_points(spark, n, levels, seed=seed))
    g = Graph.from_edges(rng_edges(p) if kind == "rng" else delaunay_edges(p), p)
    if kind == "pruned":
        return prune_detours(g, stretch)
    return largest_component(g.enforce_average_degree(degree, seed)) if kind == "thinned" else g


def hierarchical_disks(spark: SparkSession, levels: list[tuple[int, float]], seed: int = 0) -> Graph:
    """Points on a disk, then for each point k points on a smaller disk around it, and so on; the points around one centre are joined by their own Delaunay graph, and equal points are one."""
    edges = []
    k0, r0 = levels[0]
    at = points_in_disk(spark, k0, r0, seed=seed).withColumn("centre", F.lit(-1).cast("long"))
    for level, (k, r) in enumerate([*levels[1:], (0, 0.0)], 1):
        at = cut_plan(at)
        edges.append(at.groupBy("centre").applyInArrow(kernels.delaunay_of_group, "ux double, uy double, vx double, vy double"))
        if not k:
            break
        slot = at.select(F.col("id").alias("centre"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
        d, a = r * F.sqrt(uniform(seed + level, "centre", "i")), 2 * math.pi * uniform(seed + level, "centre", "i", draw=1)
        child = slot.select((F.xxhash64(F.lit(level), "centre", "i").bitwiseAND(F.lit((1 << 62) - 1))).alias("id"), (F.col("px") + d * F.cos(a)).alias("x"), (F.col("py") + d * F.sin(a)).alias("y"), "centre")
        centre = at.select("id", "x", "y", F.col("id").alias("centre"))
        at = child.union(centre)
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return Graph.from_coordinate_edges(cut_plan(out), 1e12)


def voronoi_road_network(spark: SparkSession, size: int, seed: int = 0, stretch: float = 4.0) -> Graph:
    """The largest component of the sides of nested Voronoi cells, thinned to a greedy spanner."""
    g = largest_component(kernel_graph(spark, "voronoi", size, seed))
    return greedy_spanner(Graph(cut_plan(g.vertices), cut_plan(g.edges)), stretch)


def sampled_family(spark: SparkSession, name: str, params: DataFrame) -> DataFrame:
    """(run_id, n, m) for rows (run_id, size, seed): graphs of a kernel family ('grid_degrees', 'bridged', 'voronoi', 'highway'), one task each."""
    return params.select("run_id", "size", "seed").repartition("run_id").mapInArrow(kernels.family_counts(name), "run_id long, n long, m long")


def kernel_graph(spark: SparkSession, name: str, size: int, seed: int = 0) -> Graph:
    """One graph of a kernel family, made in one task: (id, x, y) and edges."""
    made = cut_plan(spark.createDataFrame([(0, size, seed)], "run_id long, size long, seed long").mapInArrow(kernels.family_rows(name), "kind int, a long, b long, x double, y double"))
    v = made.where("kind = 0").select(F.col("a").alias("id"), "x", "y")
    return Graph.from_edges(made.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")), v)
