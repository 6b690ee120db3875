"""Diameters by sweeps, all sources, and bounds; all null (or no row) where the graph isn't connected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_plan
from .components import contract_degree2, largest_component
from .graph import Graph
from .traverse import _one, bfs, multi_bfs, multi_sssp, sampled


def furthest(distances: DataFrame) -> DataFrame:
    """One row (id, d): the largest distance, of equal ones the largest id."""
    return distances.agg(F.max(F.struct("d", "id")).alias("m")).select("m.id", "m.d")


def double_sweep(g: Graph, start: int) -> DataFrame:
    """(u, v, d): v is furthest from u, which is furthest from the start."""
    u = furthest(bfs(g, start)).first()["id"]
    return furthest(bfs(g, u)).select(F.lit(u).cast("long").alias("u"), F.col("id").alias("v"), "d")


def random_double_sweeps(g: Graph, n: int, seed: int) -> int:
    """Largest of n double sweeps from random vertices; both sweeps of all run at once."""
    ends = multi_bfs(g, sampled(g, n, seed)).groupBy("source").agg(F.max(F.struct("d", "id")).alias("m")).select(F.col("m.id").alias("id")).distinct()
    return multi_bfs(g, cut_plan(ends)).agg(F.max("d")).first()[0]


def all_bfs_diameter(g: Graph) -> int | None:
    """Exact, from every vertex; for graphs whose square fits the cluster."""
    n = g.vertices.count()
    row = multi_bfs(g, g.vertices.select("id")).agg(F.count(F.lit(1)), F.max("d")).first()
    return row[1] if row[0] == n * n else None


def contracted_double_sweep(g: Graph, start: int | None = None) -> DataFrame:
    """Double sweep on the largest component of the graph with paths contracted."""
    small = largest_component(contract_degree2(g))
    small = Graph(cut_plan(small.vertices), cut_plan(small.edges))
    first = small.vertices.agg(F.min("id")).first()[0] if start is None else start
    return double_sweep(small, first)


def ifub_diameter(g: Graph, max_levels: int | None = None) -> int | None:
    """Exact diameter by fringes: breadth-first layers of a central vertex are searched from the outside in, until the best eccentricity found can't be beaten.

    The centre is the middle of the second of two double sweeps. With max_levels only that many layers are searched,
    and the result is a lower bound.
    """
    n = g.vertices.count()
    if n <= 1:
        return 0
    start = g.degrees().agg(F.max(F.struct("degree", (-F.col("id")).alias("i")))).first()[0]["i"] * -1
    best = 0
    for _ in range(2):
        a = furthest(bfs(g, start)).first()["id"]
        tree = cut_plan(bfs(g, a))
        if tree.count() < n:
            return None
        b = furthest(tree).first()
        best = max(best, b["d"])
        at, d = b["id"], b["d"]
        while d > b["d"] // 2:
            at = tree.where(F.col("id") == at).first()["parent"]
            d -= 1
        start = at
    layers = cut_plan(bfs(g, start))
    i = layers.agg(F.max("d")).first()[0]
    searched = 0
    while i > 0 and 2 * i > best and (max_levels is None or searched < max_levels):
        best = max(best, multi_bfs(g, layers.where(F.col("d") == i).select("id")).agg(F.max("d")).first()[0])
        i, searched = i - 1, searched + 1
    return best


def weighted_double_sweep(g: Graph, start: int) -> DataFrame:
    """(u, v, d) on weights."""
    far = lambda s: furthest(multi_sssp(g, _one(g, s)).drop("source"))
    u = far(start).first()["id"]
    return far(u).select(F.lit(u).cast("long").alias("u"), F.col("id").alias("v"), "d")


def weighted_diameter_bound(g: Graph, n: int, seed: int) -> float:
    """Largest weighted distance from n random vertices."""
    return multi_sssp(g, sampled(g, n, seed)).agg(F.max("d")).first()[0]
