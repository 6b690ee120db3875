"""Detour pruning and greedy spanners. Both are sequential within a component, so each component is one group's kernel.

A component must fit a task's memory as adjacency lists; components run in parallel.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .graph import Graph

Adjacency = dict[int, dict[int, float]]


def shorter_path(adj: Adjacency, u: int, v: int, limit: float) -> bool:
    """Whether a path from u to v is strictly shorter than the limit."""
    best, heap = {u: 0.0}, [(0.0, u)]
    while heap:
        d, a = heapq.heappop(heap)
        if a == v:
            return True
        if d > best[a]:
            continue
        for b, w in adj[a].items():
            n = d + w
            if n < limit and n < best.get(b, float("inf")):
                best[b] = n
                heapq.heappush(heap, (n, b))
    return False


def _per_component(g: Graph, kernel: Callable[[list[tuple[float, int, int]]], list[tuple[int, int]]]) -> DataFrame:
    """Run a kernel on each component's edges (w, src, dst) sorted by weight, then ids; it returns the edges kept."""
    names = connected_components(g).select(F.col("id").alias("src"), "component")
    edges = (g.edges.where("src < dst") if "w" in g.edges.columns else g.edge_lengths()).select("src", "dst", "w").join(names, "src")

    def run(rows: pa.Table) -> pa.Table:
        e = sorted(zip(rows["w"].to_pylist(), rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True))
        weight = {(u, v): w for w, u, v in e}
        kept = kernel(e)
        return pa.table({"src": pa.array([u for u, _ in kept], pa.int64()), "dst": pa.array([v for _, v in kept], pa.int64()), "w": pa.array([weight[k] for k in kept], pa.float64())})

    return edges.groupBy("component").applyInArrow(run, "src long, dst long, w double")


def prune_detours(g: Graph, stretch: float, batch: int = 1) -> Graph:
    """Edges by ascending length; one goes if a detour shorter than stretch times its length is left.

    batch edges are tried on one state of the graph; 1 is the sequential rule. The result depends on batch, not on
    how many tasks run.
    """

    def kernel(edges: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
        adj: Adjacency = defaultdict(dict)
        for w, u, v in edges:
            adj[u][v] = adj[v][u] = w
        kept = []
        for at in range(0, len(edges), batch):
            gone = []
            for w, u, v in edges[at : at + batch]:
                del adj[u][v], adj[v][u]
                if shorter_path(adj, u, v, w * stretch):
                    gone.append((u, v))
                else:
                    kept.append((u, v))
                adj[u][v] = adj[v][u] = w
            for u, v in gone:
                del adj[u][v], adj[v][u]
        return kept

    return Graph.from_edges(_per_component(g, kernel), g.vertices)


def greedy_spanner(g: Graph, stretch: float, ascending: bool = False, batch: int = 1) -> Graph:
    """Edges longest first (or shortest first); one is added if it joins two parts or its ends are at least stretch times its length apart so far."""

    def kernel(edges: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
        adj: Adjacency = defaultdict(dict)
        kept: list[tuple[int, int]] = []
        order = edges if ascending else edges[::-1]
        for at in range(0, len(order), batch):
            new = [(w, u, v) for w, u, v in order[at : at + batch] if not shorter_path(adj, u, v, w * stretch)]
            for w, u, v in new:
                adj[u][v] = adj[v][u] = w
                kept.append((u, v))
        return kept

    return Graph.from_edges(_per_component(g, kernel), g.vertices)
