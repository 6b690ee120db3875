"""Minimum spanning forests by Borůvka rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_plan
from .graph import Graph


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst, w) of a minimum spanning forest of undirected (src, dst, w) rows, each edge once with src < dst.

    Ties go by (w, src, dst), so the forest is unique. A round picks the least edge of each component, merges along the
    picks by pointer jumping and drops edges within components; components at least halve.
    """
    once = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src < dst")
    left = cut_plan(once.groupBy("src", "dst").agg(F.min("w").alias("w")).select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))
    picks: list[DataFrame] = []
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        ends = left.select("a", "b", "w", "src", "dst").union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "src", "dst"))
        best = cut_plan(ends.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("m")).select("a", "m.*"))
        picks.append(best.select("src", "dst", "w").distinct())
        # follow the picks: of two components that picked each other the smaller is the root
        back = best.select(F.col("a").alias("b"), F.col("b").alias("its"))
        up = best.join(back, "b", "left").select("a", F.when((F.col("its") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("root"))
        up = cut_plan(up)
        while True:
            above = up.select(F.col("a").alias("root"), F.col("root").alias("top"))
            new = cut_plan(up.join(above, "root", "left").select("a", F.coalesce("top", "root").alias("root"), (F.col("top").isNotNull() & (F.col("top") != F.col("root"))).alias("moved")))
            up = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        names = lambda c: up.select(F.col("a").alias(c), F.col("root").alias(f"{c}_root"))
        left = left.join(names("a"), "a", "left").join(names("b"), "b", "left").select("src", "dst", "w", F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b")
        # of parallel edges between two components only the least can be picked
        left = left.select("src", "dst", "w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.min(F.struct("w", "src", "dst")).alias("m")).select("m.src", "m.dst", "m.w", "a", "b")
        left = cut_plan(left)
    if not picks:
        return left.select("src", "dst", "w")
    out = picks[0]
    for p in picks[1:]:
        out = out.union(p)
    return out.distinct()


def minimum_spanning_forest(g: Graph) -> Graph:
    """The graph on the edges of its forest, in both directions; weights are w, or lengths if there are none."""
    edges = g.edges if "w" in g.edges.columns else g.edge_lengths()
    found = spanning_forest(edges.select("src", "dst", "w"))
    return Graph.from_edges(found, g.vertices)
