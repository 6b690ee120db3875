"""Rooted forests as (id, parent) rows, parent null at roots: depths, ancestors, subtree sizes, lowest common ancestors.

Ancestors are doubled (binary lifting), so a tree of depth h takes log2 h rounds and n log2 h rows, also if it is a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_plan
from .graph import Graph
from .traverse import bfs


def rooted(g: Graph, root: int) -> DataFrame:
    """(id, parent) of a tree graph seen from a root."""
    return bfs(g, root).select("id", "parent")


def lifting_table(tree: DataFrame) -> tuple[DataFrame, int]:
    """(id, k, anc): the ancestor 2^k above, for those that there are; and the number of levels k."""
    level = cut_plan(tree.where("parent IS NOT NULL").select("id", F.lit(0).alias("k"), F.col("parent").alias("anc")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        up = level.select(F.col("id").alias("mid"), F.col("anc").alias("top"))
        level = cut_plan(level.join(up, level["anc"] == up["mid"]).select("id", F.lit(len(levels)).alias("k"), F.col("top").alias("anc")))
    out = level
    for x in levels:
        out = out.union(x)
    return out, len(levels)


def depths(tree: DataFrame) -> DataFrame:
    """(id, depth, root), by pointer doubling."""
    at = cut_plan(tree.select("id", F.coalesce("parent", "id").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:
        up = at.select(F.col("id").alias("mid"), F.col("anc").alias("top"), F.col("depth").alias("more"))
        new = cut_plan(at.join(up, at["anc"] == up["mid"]).select("id", F.col("top").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at.select("id", "depth", F.col("anc").alias("root"))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(id, size): vertices below and with each.

    Sizes of the parts within 2^k steps double in depth from round to round: to a vertex's part come those of the vertices
    whose 2^k-th ancestor it is. A tree of depth h takes log2 h rounds.
    """
    table, levels = lifting_table(tree)
    size = cut_plan(tree.select("id", F.lit(1).cast("long").alias("size")))
    for k in range(levels):
        more = table.where(F.col("k") == k).join(size, "id").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        size = cut_plan(size.join(more, "id", "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return size


def lca(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, lca, distance) for pairs (u, v); no row for pairs in different trees."""
    table, levels = lifting_table(tree)
    d = cut_plan(depths(tree))
    at = pairs.select("u", "v").distinct()
    for c in ("u", "v"):
        at = at.join(d.select(F.col("id").alias(c), F.col("depth").alias(f"d{c}"), F.col("root").alias(f"r{c}")), c)
    at = at.where("ru = rv").select("u", "v", "du", "dv", F.when(F.col("du") >= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("a"), F.when(F.col("du") >= F.col("dv"), F.col("v")).otherwise(F.col("u")).alias("b"), F.abs(F.col("du") - F.col("dv")).alias("gap"))
    at = cut_plan(at)
    up = lambda k, c: table.where(F.col("k") == k).select(F.col("id").alias(c), F.col("anc").alias(f"{c}_up"))
    for k in range(levels - 1, -1, -1):  # lift the deeper one
        at = at.join(up(k, "a"), "a", "left").withColumn("a", F.when(F.expr(f"gap >= {1 << k}"), F.col("a_up")).otherwise(F.col("a"))).withColumn("gap", F.expr(f"CASE WHEN gap >= {1 << k} THEN gap - {1 << k} ELSE gap END")).drop("a_up")
    at = cut_plan(at)
    for k in range(levels - 1, -1, -1):  # lift both while they differ
        at = at.join(up(k, "a"), "a", "left").join(up(k, "b"), "b", "left")
        moves = F.col("a_up").isNotNull() & F.col("b_up").isNotNull() & (F.col("a_up") != F.col("b_up")) & (F.col("a") != F.col("b"))
        at = at.withColumn("m", moves).select("u", "v", "du", "dv", F.when(F.col("m"), F.col("a_up")).otherwise(F.col("a")).alias("a"), F.when(F.col("m"), F.col("b_up")).otherwise(F.col("b")).alias("b"))
    up0 = up(0, "a")
    found = at.join(up0, "a", "left").select("u", "v", "du", "dv", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a_up")).alias("lca"))
    top = d.select(F.col("id").alias("lca"), F.col("depth").alias("dl"))
    return found.join(top, "lca").select("u", "v", "lca", (F.col("du") + F.col("dv") - 2 * F.col("dl")).alias("distance"))
