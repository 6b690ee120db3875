"""Proximity graphs over points (id, x, y): nearest neighbours, unit disks, Delaunay, Gabriel, relative neighbours.

Edges are (src, dst), src < dst, unless said otherwise; wrap them with Graph.from_edges(edges, points).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell, dist2
from ..runtime import cut_plan
from .components import largest_component
from .graph import Graph
from .spatial import box_cells, knn_join, radius_join
from .triangulate import Triangulation


def unit_disk_edges(points: DataFrame, r: float = 1.0) -> DataFrame:
    """Pairs at a distance below r, no point with itself."""
    return radius_join(points, points, r).where((F.col("u") < F.col("v")) & (F.col("d2") < r * r)).select(F.col("u").alias("src"), F.col("v").alias("dst"))


def unit_disk_graph(points: DataFrame, r: float = 1.0, degree: float | None = None, seed: int = 0) -> Graph:
    """Largest component of the unit-disk graph, after random edges are dropped down to the average degree if one is given."""
    g = Graph.from_edges(unit_disk_edges(points, r), points)
    return largest_component(g if degree is None else g.enforce_average_degree(degree, seed))


def knn_edges(points: DataFrame, k: int) -> DataFrame:
    """Pairs of which one is among the other's k nearest."""
    near = knn_join(points, points, k)
    return near.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def knn_graph(points: DataFrame, k: int) -> Graph:
    return largest_component(Graph.from_edges(knn_edges(points, k), points))


def delaunay_edges(points: DataFrame, tile_points: int = 20_000, halo: float = 0.5) -> DataFrame:
    """Edges of the Delaunay triangulation; of points with equal coordinates the smallest id stands for all.

    Points are dealt to square tiles of about tile_points, with those up to `halo` of a side around, and each tile is
    triangulated by itself. A triangle whose circle lies within a tile and its halo is final. A point is settled when all
    triangles around it are final. What is missing has only unsettled corners, and it is found by triangulating the
    unsettled points with their settled neighbours alone: any disk's points are connected in the triangulation, so a
    settled point in a wrong triangle's circle would come with one that is a neighbour of an unsettled point. Rounds go on
    with fewer points and larger tiles until one tile holds them all. Dense places make full tiles: choose tile_points for
    the densest.
    """
    own = points.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y", F.lit(True).alias("open"))
    left = cut_plan(own)
    found: list[DataFrame] = []
    grow = 1.0
    while True:
        box = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
        if box[4] < 2:
            break
        extent = max(box[1] - box[0], box[3] - box[2]) or 1.0
        per_side = max(1, int((box[4] / (tile_points * grow)) ** 0.5))
        made = cut_plan(_tiles(left, box[:4], extent / per_side, per_side, halo).groupBy("tx", "ty").applyInArrow(_kernel(box[:4], extent / per_side, per_side, halo), "src long, dst long, settled long"))
        found.append(made.where("settled IS NULL").select("src", "dst"))
        if per_side == 1:
            break
        settled = made.where("settled IS NOT NULL").select(F.col("settled").alias("id")).distinct()
        open_ = cut_plan(left.where("open").join(settled, "id", "left_anti").select("id", "x", "y"))
        both = made.where("settled IS NULL").select("src", "dst")
        ends = both.union(both.select("dst", "src")).toDF("id", "other")
        near = ends.join(open_.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(open_, "id", "left_anti")
        left = cut_plan(open_.withColumn("open", F.lit(True)).union(left.join(near, "id", "left_semi").select("id", "x", "y", F.lit(False))))
        grow *= 2
    if not found:
        return left.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def _tiles(rows: DataFrame, box: tuple, side: float, per_side: int, halo: float) -> DataFrame:
    """Each point in its tile and in those whose halo it lies in, with `core` for its own."""
    for c, lo in (("x", box[0]), ("y", box[2])):
        own = F.least(F.floor((F.col(c) - lo) / side), F.lit(per_side - 1)).cast("int")
        at = (F.col(c) - lo) / side
        rows = rows.withColumn(f"o{c}", own).withColumn(f"t{c}", F.explode(F.array_distinct(F.array(own, F.floor(at - halo).cast("int"), F.floor(at + halo).cast("int"))))).where(F.col(f"t{c}").between(0, per_side - 1))
    return rows.select("id", "x", "y", "open", "tx", "ty", ((F.col("ox") == F.col("tx")) & (F.col("oy") == F.col("ty"))).alias("core"))


def _kernel(box: tuple, side: float, per_side: int, halo: float):  # noqa: ANN202
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, x, y = (rows[c].to_numpy() for c in ("id", "x", "y"))
        is_open, core = (np.array(rows[c].to_pylist(), bool) for c in ("open", "core"))
        tx, ty = (k.as_py() for k in key)
        t = Triangulation(x, y)
        tri = t.triangles()
        if per_side == 1 or not len(tri):
            # the whole set: everything is final (and without a triangle in a small tile, nothing is)
            pairs = t.edges() if per_side == 1 else []
            pairs = [(a, b) for a, b in pairs if is_open[a] and is_open[b]]
            e = np.array(pairs, np.int64).reshape(-1, 2)
            lo, hi = np.minimum(ids[e[:, 0]], ids[e[:, 1]]), np.maximum(ids[e[:, 0]], ids[e[:, 1]])
            return pa.table({"src": pa.array(lo), "dst": pa.array(hi), "settled": pa.nulls(len(e), pa.int64())})
        a, b, c = tri.T
        bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
        with np.errstate(all="ignore"):
            d = 2 * (bx * cy - by * cx)
            ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
            r = np.hypot(ux, uy) * (1 + 1e-9)
        mx, my = x[a] + ux, y[a] + uy
        edge = lambda k, lo, first: -np.inf if first and k == 0 else np.inf if not first and k == per_side - 1 else lo + side * (k - halo if first else k + 1 + halo)
        final = np.isfinite(r) & (mx - r > edge(tx, box[0], True)) & (mx + r < edge(tx, box[0], False)) & (my - r > edge(ty, box[2], True)) & (my + r < edge(ty, box[2], False))
        bad = np.zeros(len(ids), bool)
        bad[list(t.hull())] = True
        bad[tri[~final].ravel()] = True
        known = np.zeros(len(ids), bool)
        known[tri.ravel()] = True
        settled = ids[core & is_open & known & ~bad]
        good = tri[final & is_open[a] & is_open[b] & is_open[c]] if not is_open.all() else tri[final]
        e = np.concatenate([good[:, [0, 1]], good[:, [1, 2]], good[:, [2, 0]]])
        e = np.unique(np.c_[np.minimum(ids[e[:, 0]], ids[e[:, 1]]), np.maximum(ids[e[:, 0]], ids[e[:, 1]])], axis=0).reshape(-1, 2)
        is_edge = np.arange(len(e) + len(settled)) < len(e)
        return pa.table({"src": pa.array(np.r_[e[:, 0], settled], mask=~is_edge), "dst": pa.array(np.r_[e[:, 1], settled], mask=~is_edge), "settled": pa.array(np.r_[e[:, 0], settled], mask=is_edge)})

    return run


def with_points(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, x1, y1, x2, y2, d2)."""
    a = points.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").withColumn("d2", dist2("x1", "y1", "x2", "y2"))


def _common_witness(edges: DataFrame, points: DataFrame, blocked) -> DataFrame:  # noqa: ANN001
    """Edges without a common neighbour in `edges` that blocks them."""
    e = with_points(edges, points)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("p", "w")
    first = e.join(both.select(F.col("p").alias("src"), "w"), "src")
    common = first.join(both.select(F.col("p").alias("dst"), "w"), ["dst", "w"])
    at = points.select(F.col("id").alias("w"), F.col("x").alias("wx"), F.col("y").alias("wy"))
    bad = common.join(at, "w").where(blocked(dist2("x1", "y1", "wx", "wy"), dist2("x2", "y2", "wx", "wy"), F.col("d2"))).select("src", "dst")
    return e.select("src", "dst").join(bad, ["src", "dst"], "left_anti")


def gabriel_edges(points: DataFrame, delaunay: DataFrame | None = None) -> DataFrame:
    """Delaunay edges without a point strictly inside the circle over them; common Delaunay neighbours suffice as witnesses."""
    return _common_witness(cut_plan(delaunay_edges(points)) if delaunay is None else delaunay, points, lambda a, b, d: a + b < d)


def rng_edges(points: DataFrame, delaunay: DataFrame | None = None, witness: str = "delaunay") -> DataFrame:
    """Edges without a point nearer to both ends than they are to each other.

    witness 'delaunay' tries common Delaunay neighbours only and keeps some more edges; 'all' is the relative
    neighbourhood graph proper: the edges that are left are tried against the points of the grid cells of their lunes.
    """
    some = _common_witness(cut_plan(delaunay_edges(points)) if delaunay is None else delaunay, points, lambda a, b, d: F.greatest(a, b) < d)
    if witness == "delaunay":
        return some
    e = cut_plan(with_points(some, points))
    size = e.agg(F.sqrt(F.percentile_approx("d2", 0.9))).first()[0] or 1.0
    # the lune lies within a box around the edge; its half sides are those of a square over the edge's length
    mx, my, half = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.sqrt("d2") * 0.8660254037844387
    boxes = box_cells(e.withColumns({"bx1": mx - half, "bx2": mx + half, "by1": my - half, "by2": my + half}), size, "bx1", "by1", "bx2", "by2")
    at = points.select(F.col("id").alias("w"), F.col("x").alias("wx"), F.col("y").alias("wy"), cell("x", size).alias("cx"), cell("y", size).alias("cy"))
    inside = F.greatest(dist2("x1", "y1", "wx", "wy"), dist2("x2", "y2", "wx", "wy")) < F.col("d2")
    bad = boxes.join(at, ["cx", "cy"]).where((F.col("w") != F.col("src")) & (F.col("w") != F.col("dst")) & inside).select("src", "dst").distinct()
    return e.select("src", "dst").join(bad, ["src", "dst"], "left_anti")


def shortest_fraction(edges: DataFrame, points: DataFrame, fraction: float) -> DataFrame:
    """The floor(m * fraction) shortest edges, ties by ids."""
    e = cut_plan(with_points(edges, points))
    return e.orderBy("d2", "src", "dst").limit(int(e.count() * fraction)).select("src", "dst")


def max_length(edges: DataFrame, points: DataFrame, length: float) -> DataFrame:
    """Edges no longer than the length."""
    return with_points(edges, points).where(F.col("d2") <= length * length).select("src", "dst")


def delaunay_average_degree(points: DataFrame, degree: float, seed: int) -> Graph:
    """Largest component of the shortest 99 % of Delaunay edges, after random ones are dropped down to the average degree."""
    d = cut_plan(delaunay_edges(points))
    return largest_component(Graph.from_edges(shortest_fraction(d, points, 0.99), points).enforce_average_degree(degree, seed))
