"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_plan
from .graph import Graph


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def star_forest(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex that has an edge to another: component is the smallest id that it is connected to.

    Large stars tie each larger neighbour to the smallest neighbour, small stars each smaller one; both keep components
    whole, and the edges soon form one star for each (Kiveris et al., 2014). Minima are pre-aggregated before the
    shuffle, so a hub costs one row a task there. Each round is checkpointed, so that the plan stays short and lost
    executors cost one round at most.
    """
    e = edges.select(F.least(src, dst).alias("v"), F.greatest(src, dst).alias("u")).where("u <> v").distinct()
    e = cut_plan(e)
    before = _mark(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut_plan(small)
        after = _mark(e)
        if after == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(g: Graph) -> DataFrame:
    """(id, component) of all vertices; component is the smallest id in it, an isolated vertex its own."""
    found = star_forest(g.edges)
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(g: Graph) -> DataFrame:
    return connected_components(g).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def is_connected(g: Graph) -> bool:
    return connected_components(g).select("component").distinct().limit(2).count() <= 1


def components_minus_separator(g: Graph, separator: DataFrame, min_size: int = 0) -> DataFrame:
    """(id, component) of what is left without the separator's vertices (id), parts of more than min_size only."""
    found = cut_plan(connected_components(g.without_vertices(separator)))
    if min_size == 0:
        return found
    large = found.groupBy("component").count().where(F.col("count") > min_size).select("component")
    return found.join(large, "component", "left_semi").select("id", "component")


def largest_component(g: Graph) -> Graph:
    """The part on the component with most vertices; of equal ones that with the smallest id."""
    found = cut_plan(connected_components(g))
    top = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return g.induced(found.join(F.broadcast(top), "component", "left_semi").select("id"))


def contract_degree2(g: Graph) -> Graph:
    """Paths through vertices of degree 2 replaced by one edge between their ends; the inner vertices stay, isolated.

    Chains are the components of the part on degree-2 vertices. A chain between two different ends becomes an edge; one
    that returns to the same end, or a whole cycle, is contracted by ascending id as far as a simple graph allows: of a
    cycle the edge between its two largest ids stays, of a loop at an end the edge to its largest inner vertex.
    """
    deg2 = g.degrees().where("degree = 2").select("id")
    inner = cut_plan(connected_components(g.induced(deg2)))
    out = g.edges.select("src", "dst").join(inner.select(F.col("id").alias("src"), "component"), "src").join(deg2.withColumnRenamed("id", "dst"), "dst", "left_anti")
    ends = out.groupBy("component").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    last = inner.groupBy("component").agg(F.max("id").alias("top"))
    second = inner.join(last, "component").where("id < top").groupBy("component").agg(F.max("id").alias("second"))
    joined = last.join(second, "component", "left").join(ends, "component", "left").select(
        F.coalesce("a", "second").alias("src"), F.when(F.col("a").isNull() | (F.col("a") == F.col("b")), F.col("top")).otherwise(F.col("b")).alias("dst")
    )
    kept = g.edges.select("src", "dst").join(deg2.withColumnRenamed("id", "src"), "src", "left_anti").join(deg2.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph.from_edges(kept.union(joined.where("src IS NOT NULL AND dst IS NOT NULL")), g.vertices)
