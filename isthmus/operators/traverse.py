"""Hop and weighted traversals as frontier loops over all sources at once.

Each round joins the frontier with the edges, keeps the best row for each (source, vertex) and is checkpointed. Vertices
that can't be reached have no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dist
from ..runtime import cut_plan
from .disk import DiskGraph
from .graph import Graph
from .stats import bin_edges, histogram

KEY = ["source", "id"]


def multi_bfs(g: Graph, sources: DataFrame, max_hops: int | None = None, targets: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """(source, id, d, parent) from each source id; parent is the smallest vertex one hop nearer, null at the source.

    In an undirected graph new vertices can only touch the last two layers, so only those are excluded. With targets
    (ids), the search ends when all are reached from all sources, and with enough after the layer with which there are
    so many rows.
    """
    edges = g.edges.select("src", "dst")
    layer = cut_plan(sources.select(F.col("id").alias("source"), "id").distinct().join(g.vertices.select("id"), "id", "left_semi").select("source", "id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("parent")))
    layers, hop = [layer], 0
    goal = None if targets is None else layer.count() * targets.select("id").distinct().count()
    met = seen = 0
    while max_hops is None or hop < max_hops:
        if enough is not None:
            seen += layer.count()
            if seen >= enough:
                break
        if goal is not None:
            met += layer.join(targets.select("id").distinct(), "id", "left_semi").count()
            if met >= goal:
                break
        hop += 1
        reached = layer.select("source", F.col("id").alias("src")).join(edges, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        near = layers if g.directed else layers[-2:]
        for old in near:
            reached = reached.join(old.select(*KEY), KEY, "left_anti")
        layer = cut_plan(reached.select("source", "id", F.lit(hop).cast("long").alias("d"), "parent"))
        if layer.isEmpty():
            break
        layers.append(layer)
    out = layers[0]
    for x in layers[1:]:
        out = out.union(x)
    return out


def bfs(g: Graph, source: int, max_hops: int | None = None) -> DataFrame:
    """(id, d, parent)."""
    return multi_bfs(g, _one(g, source), max_hops).drop("source")


def _one(g: Graph, id_: int) -> DataFrame:
    return g.vertices.sparkSession.range(id_, id_ + 1)


def hop_distance(g: Graph, source: int, target: int) -> DataFrame:
    """(source, target, d); no row if the target can't be reached."""
    found = multi_bfs(g, _one(g, source), targets=_one(g, target)).where(F.col("id") == target)
    return found.select("source", F.col("id").alias("target"), "d")


def multi_target_hops(g: Graph, source: int, targets: DataFrame) -> DataFrame:
    """(target, d)."""
    return multi_bfs(g, _one(g, source), targets=targets).join(targets.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target"), "d")


def bounded_bfs(g: Graph, source: int, most: int) -> DataFrame:
    """(id, d) of the `most` vertices nearest to the source, without it; the last layer is cut by id."""
    found = multi_bfs(g, _one(g, source), enough=most + 1)
    return found.where("d > 0").orderBy("d", "id").limit(most).select("id", "d")


class _Layers:
    """Rows (key.., d) of a search as checkpointed layers, each holding what one round improved; now and then they become one."""

    def __init__(self, key: list[str], first: DataFrame, most: int = 6) -> None:
        self.key, self.rows, self.most = key, [first], most

    def best(self) -> DataFrame:
        out = self.rows[0]
        for x in self.rows[1:]:
            out = out.union(x)
        return out if len(self.rows) == 1 else out.groupBy(*self.key).agg(F.min("d").alias("d"))

    def improved(self, step: DataFrame) -> DataFrame:
        """The rows of a step that are new or better, as the next layer."""
        base = self.best().withColumnRenamed("d", "known")
        fresh = cut_plan(step.join(base, self.key, "left").where("known IS NULL OR d < known").select(*self.key, "d"))
        if len(self.rows) >= self.most:
            self.rows = [cut_plan(self.best())]
        self.rows.append(fresh)
        return fresh


def _relaxed(fresh: DataFrame, hops: int, one: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Least distances over 1 to `hops` further edges from the fresh rows, in one plan."""
    out = None
    for _ in range(hops):
        fresh = one(fresh).groupBy(*key).agg(F.min("d").alias("d"))
        out = fresh if out is None else out.union(fresh)
    return out.groupBy(*key).agg(F.min("d").alias("d")) if hops > 1 else out


def multi_sssp(g: Graph, sources: DataFrame, limit: float | None = None, strict: bool = True, avoid: DataFrame | None = None, target: int | None = None, hops: int = 2, max_rounds: int = 100_000) -> DataFrame:
    """(source, id, d): least weight sums from each source; only distances below the limit (or up to it, if not strict).

    A round relaxes `hops` edges from the rows that improved, and stores only what it improves. With avoid, (source, src,
    dst) rows, a source doesn't use those edges. With a target, rows no nearer than it are searched no further, so only
    its distance and those of nearer vertices are final. The edges of a DiskGraph are met on the grid, a hop a round.
    """
    met = isinstance(g, DiskGraph) and avoid is None
    hops = 1 if met else hops
    edges = None if met else g.edges.select("src", "dst", "w")
    fresh = cut_plan(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("d", F.lit(0.0)))
    layers = _Layers(KEY, fresh)

    def one(rows: DataFrame) -> DataFrame:
        if met:
            step = g.steps(rows)
        else:
            step = rows.select("source", F.col("id").alias("src"), "d").join(edges, "src")
            if avoid is not None:
                step = step.join(avoid, ["source", "src", "dst"], "left_anti")
            step = step.select("source", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"))
        return step if limit is None else step.where(F.col("d") < limit if strict else F.col("d") <= limit)

    for _ in range(max_rounds):
        start = fresh
        if target is not None:
            goal = layers.best().where(F.col("id") == target).select("source", F.col("d").alias("goal"))
            start = fresh.join(goal, "source", "left").where("goal IS NULL OR d < goal").drop("goal")
        fresh = layers.improved(_relaxed(start, hops, one, KEY))
        if fresh.isEmpty():
            return layers.best()
    raise RuntimeError("distances did not settle")


def shortest_distance(g: Graph, source: int, target: int) -> DataFrame:
    """(source, target, d) by weights, with an early stop at the target; no row if it can't be reached."""
    return multi_sssp(g, _one(g, source), target=target).where(F.col("id") == target).select("source", F.col("id").alias("target"), "d")


def sssp(g: Graph, source: int) -> DataFrame:
    """(id, d)."""
    return multi_sssp(g, _one(g, source)).drop("source")


def within_distance(g: Graph, asked: DataFrame, strict: bool = True, ignore_edge: bool = False, hops: int = 2, max_rounds: int = 100_000) -> DataFrame:
    """(qid, within) for rows (qid, u, v, bound): whether a path from u to v is shorter than the bound; u = v always is.

    All questions run in one loop. If the vertices have positions, a row is dropped when its distance so far and the
    straight line to v already reach the bound (the A* bound), so a search stays inside its ellipse. With ignore_edge
    the edge (u, v) itself isn't used.
    """
    ok = (lambda d: d < F.col("bound")) if strict else (lambda d: d <= F.col("bound"))
    edges = g.edges.select("src", "dst", "w")
    q = asked.select("qid", "u", "v", "bound")
    placed = "x" in g.vertices.columns
    if placed:
        q = q.join(g.vertices.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
        edges = edges.join(g.vertices.select(F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy")), "dst")
    q = cut_plan(q)
    key = ["qid", "id"]
    fresh = cut_plan(q.select("qid", F.col("u").alias("id"), F.lit(0.0).alias("d")))
    layers = _Layers(key, fresh)
    goals = q.select("qid", F.col("v").alias("id"))

    def one(rows: DataFrame) -> DataFrame:
        step = rows.withColumnRenamed("id", "src").join(q, "qid").join(edges, "src")
        if ignore_edge:
            step = step.where("NOT ((src = u AND dst = v) OR (src = v AND dst = u))")
        step = step.withColumn("n", F.col("d") + F.col("w")).where(ok(F.col("n")))
        if placed:
            step = step.where(ok(F.col("n") + dist("dx", "dy", "vx", "vy") * (1 - 1e-12)))
        return step.select("qid", F.col("dst").alias("id"), F.col("n").alias("d"))

    done = None
    for _ in range(max_rounds):
        done = layers.best().join(goals, key, "left_semi").select("qid")  # answered questions are searched no further
        fresh = layers.improved(_relaxed(fresh.join(done, "qid", "left_anti"), hops, one, key))
        if fresh.isEmpty():
            return asked.select("qid").join(done.withColumn("within", F.lit(True)), "qid", "left").select("qid", F.coalesce("within", F.lit(False)).alias("within"))
    raise RuntimeError("questions are left unanswered")


def path_nodes(g: Graph, source: int, target: int) -> DataFrame:
    """(step, id) of one shortest hop path, smallest parents first; no rows if there is none."""
    tree = cut_plan(multi_bfs(g, _one(g, source), targets=_one(g, target)).drop("source"))
    at = tree.where(F.col("id") == target)
    parts = [at.select(F.col("d").alias("step"), "id")]
    d = at.select("d").first()
    for _ in range(d[0] if d else 0):
        at = cut_plan(tree.alias("t").join(at.alias("a"), F.col("t.id") == F.col("a.parent")).select("t.*"))
        parts.append(at.select(F.col("d").alias("step"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def path_midpoint(g: Graph, source: int, target: int) -> int:
    """The vertex at half the path's number of vertices, rounded down; the source if there is no path."""
    path = path_nodes(g, source, target)
    n = path.count()
    row = path.where(F.col("step") == n // 2).first()
    return row["id"] if row else source


def hop_histogram(g: Graph, sources: DataFrame, include_max: bool = True) -> DataFrame:
    """(d, cnt) of hops above 0 from all sources; without include_max the largest is left out."""
    h = multi_bfs(g, sources).where("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("cnt"))
    return h if include_max else h.join(h.agg(F.max("d").alias("d")), "d", "left_anti")


def distance_histogram(g: Graph, sources: DataFrame, k: int) -> DataFrame:
    """Right-closed histogram with k bins of the weighted distances from all sources, up to the largest."""
    d = cut_plan(multi_sssp(g, sources))
    top = d.agg(F.max("d")).first()[0]
    return histogram(d, "d", bin_edges(k, top or 0.0))


def sampled(g: Graph, n: int, seed: int) -> DataFrame:
    """n random vertices (id)."""
    from ..functions.geometry import uniform

    return g.vertices.select("id", uniform(seed, "id").alias("u")).orderBy("u", "id").limit(n).select("id")
