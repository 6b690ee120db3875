"""Planarisation: crossings become vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import dist2
from ..runtime import cut_plan
from .graph import Graph, numbered
from .spatial import segment_box_join
from .stats import meshedness


def crossings(g: Graph, apart2: float = 1e-8) -> DataFrame:
    """(s1, d1, s2, d2, x, y): proper crossings of two edges, farther than sqrt(apart2) from all four ends.

    Candidates are pairs whose boxes touch, found in grid cells; the crossing solves p + t r = q + u s.
    """
    seg = numbered(g.segments(), ["src", "dst"], "e").select("e", "src", "dst", "x1", "y1", "x2", "y2")
    p = segment_box_join(cut_plan(seg))
    rx, ry, sx, sy = F.col("x2_a") - F.col("x1_a"), F.col("y2_a") - F.col("y1_a"), F.col("x2_b") - F.col("x1_b"), F.col("y2_b") - F.col("y1_b")
    qx, qy = F.col("x1_b") - F.col("x1_a"), F.col("y1_b") - F.col("y1_a")
    den = rx * sy - ry * sx  # zero if they are parallel, which gives null and no crossing
    p = p.withColumns({"t": F.try_divide(qx * sy - qy * sx, den), "u": F.try_divide(qx * ry - qy * rx, den)}).where("t > 0 AND t < 1 AND u > 0 AND u < 1")
    p = p.withColumns({"x": F.col("x1_a") + F.col("t") * rx, "y": F.col("y1_a") + F.col("t") * ry})
    for c in ("1_a", "2_a", "1_b", "2_b"):
        p = p.where(dist2("x", "y", f"x{c}", f"y{c}") > apart2)
    return p.select(F.col("src_a").alias("s1"), F.col("dst_a").alias("d1"), F.col("src_b").alias("s2"), F.col("dst_b").alias("d2"), "x", "y")


def planarize(g: Graph, apart2: float = 1e-8) -> Graph:
    """The graph with a new vertex at each crossing, both edges split there. New ids follow the largest old one, in order of the edge pairs."""
    top = g.vertices.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    new = cut_plan(numbered(crossings(g, apart2), ["s1", "d1", "s2", "d2"], "n").withColumn("id", F.col("n") + (top + 1)))
    on = new.select(F.col("s1").alias("src"), F.col("d1").alias("dst"), "id", "x", "y").union(new.select("s2", "d2", "id", "x", "y"))
    seg = g.segments()
    ends = seg.select("src", "dst", F.col("src").alias("id"), F.lit(0.0).alias("at")).union(seg.select("src", "dst", "dst", F.lit(2.0)))
    inner = on.join(seg, ["src", "dst"]).select("src", "dst", "id", (dist2("x", "y", "x1", "y1") / dist2("x2", "y2", "x1", "y1")).alias("at"))
    pieces = ends.union(inner).select(F.col("id").alias("a"), F.lead("id").over(Window.partitionBy("src", "dst").orderBy("at", "id")).alias("b")).where("b IS NOT NULL")
    vertices = g.vertices.select("id", "x", "y").union(new.select("id", "x", "y"))
    return Graph.from_edges(pieces.toDF("src", "dst"), vertices)


def planar_meshedness(g: Graph) -> DataFrame:
    """Meshedness of the planarised graph."""
    p = planarize(g)
    n = p.vertices.agg(F.count(F.lit(1)).alias("n"))
    m = p.edges.agg((F.count(F.lit(1)) / 2).alias("m"))
    return n.crossJoin(m).select(meshedness(F.col("n"), F.col("m")).alias("meshedness"))
