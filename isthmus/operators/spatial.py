"""Spatial joins on grid cells: equi-joins on cell numbers with the exact test after, never all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import cell, dist2
from ..runtime import cut_plan


def _around(rows: DataFrame, axes: list[str], size: float) -> DataFrame:
    """Each row once for each of the 3^d cells around its own."""
    for a in axes:
        rows = rows.withColumn(f"c{a}", F.explode(F.array(*(cell(a, size) + k for k in (-1, 0, 1)))))
    return rows


def radius_join(a: DataFrame, b: DataFrame, r: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(u, v, d2) with u from a, v from b and a distance of at most r. Cells have side r, so 3^d cells around suffice."""
    left = _around(a.select(F.col("id").alias("u"), *(F.col(c).alias(f"a{c}") for c in axes)), [f"a{c}" for c in axes], r)
    right = b.select(F.col("id").alias("v"), *(F.col(c).alias(f"b{c}") for c in axes), *(cell(c, r).alias(f"ca{c}") for c in axes))
    both = left.join(right, [f"ca{c}" for c in axes])
    d2 = None
    for c in axes:
        d = F.col(f"a{c}") - F.col(f"b{c}")
        d2 = d * d if d2 is None else d2 + d * d
    return both.withColumn("d2", d2).where(F.col("d2") <= r * r).select("u", "v", "d2")


def knn_join(a: DataFrame, b: DataFrame, k: int, exclude_same_id: bool = True, per_cell: float = 2.0) -> DataFrame:
    """(u, v, d2, rank): for each point of a the k nearest of b, ties by id.

    Cells first hold about `per_cell` points. A point is done when its k-th neighbour among the 3x3 cells around is not
    farther than a cell's side, which nothing outside can beat; the others go on with cells of double the side.
    """
    box = b.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    left = cut_plan(a.select(F.col("id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")))
    if not box[4]:
        return left.select("u", F.lit(0).cast("long").alias("v"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    ext = a.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    lo_x, hi_x, lo_y, hi_y = (f(x for x in (p, q) if x is not None) for f, p, q in zip((min, max, min, max), box[:4], ext, strict=True))
    extent = max(hi_x - lo_x, hi_y - lo_y, 1e-12)
    area = max((box[1] - box[0]) * (box[3] - box[2]), extent * extent * 1e-6)
    size = max((per_cell * area / box[4]) ** 0.5, extent / 2**20)
    done = []
    while True:
        right = b.select(F.col("id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x", size).alias("cax"), cell("y", size).alias("cay"))
        near = _around(left, ["ax", "ay"], size).join(right, ["cax", "cay"])
        if exclude_same_id:
            near = near.where("u <> v")
        near = near.withColumn("d2", dist2("ax", "ay", "bx", "by"))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d2", "v"))).where(F.col("rank") <= k).select("u", "ax", "ay", "v", "d2", "rank")
        last = size > extent
        if last:
            done.append(ranked.select("u", "v", "d2", "rank"))
            break
        ranked = cut_plan(ranked)
        full = ranked.where((F.col("rank") == k) & (F.col("d2") <= size * size)).select("u")
        done.append(ranked.join(full, "u", "left_semi").select("u", "v", "d2", "rank"))
        left = cut_plan(left.join(full, "u", "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def nearest(a: DataFrame, b: DataFrame, exclude_same_id: bool = False) -> DataFrame:
    """(u, v, d2)."""
    return knn_join(a, b, 1, exclude_same_id).drop("rank")


def box_cells(rows: DataFrame, size: float, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """Each segment once for each cell that its bounding box touches."""
    span = lambda p, q: F.sequence(F.floor(F.least(p, q) / size).cast("long"), F.floor(F.greatest(p, q) / size).cast("long"))
    return rows.withColumn("cx", F.explode(span(F.col(x1), F.col(x2)))).withColumn("cy", F.explode(span(F.col(y1), F.col(y2))))


def segment_box_join(segments: DataFrame, size: float | None = None) -> DataFrame:
    """(e1, e2, ...) for pairs e1 < e2 of segments (e, x1, y1, x2, y2) whose bounding boxes touch.

    Boxes meet in cells of about the mean box side; a pair is kept in one cell only, the first that both boxes share.
    """
    if size is None:
        size = segments.agg(F.avg(F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2"))))).first()[0] or 1.0
    cells = box_cells(segments, size)
    low = lambda t, p, q: F.least(F.col(f"{t}.{p}"), F.col(f"{t}.{q}"))
    high = lambda t, p, q: F.greatest(F.col(f"{t}.{p}"), F.col(f"{t}.{q}"))
    both = cells.alias("a").join(cells.alias("b"), F.expr("a.cx = b.cx AND a.cy = b.cy AND a.e < b.e"))
    meet = (low("a", "x1", "x2") <= high("b", "x1", "x2")) & (low("b", "x1", "x2") <= high("a", "x1", "x2")) & (low("a", "y1", "y2") <= high("b", "y1", "y2")) & (low("b", "y1", "y2") <= high("a", "y1", "y2"))
    first = (F.col("a.cx") == F.floor(F.greatest(low("a", "x1", "x2"), low("b", "x1", "x2")) / size)) & (F.col("a.cy") == F.floor(F.greatest(low("a", "y1", "y2"), low("b", "y1", "y2")) / size))
    names = [F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in segments.columns if c != "e"]
    return both.where(meet & first).select(F.col("a.e").alias("e1"), F.col("b.e").alias("e2"), *names)


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(id, polygon) of points (id, x, y) in polygons (polygon, xs, ys). The polygons are exploded to the grid cells of their boxes; points meet only those of their cell."""
    from ..functions.geometry import in_polygon

    p = polygons.withColumns({"x1": F.array_min("xs"), "x2": F.array_max("xs"), "y1": F.array_min("ys"), "y2": F.array_max("ys")})
    size = p.agg(F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] or 1.0
    cells = box_cells(p, size)
    mine = points.select("id", "x", "y", cell("x", size).alias("cx"), cell("y", size).alias("cy"))
    return mine.join(cells, ["cx", "cy"]).where(in_polygon(F.col("x"), F.col("y"), F.col("xs"), F.col("ys"))).select("id", "polygon")
