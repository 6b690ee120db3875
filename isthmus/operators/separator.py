"""Vertex orders, elimination trees, separator sizes, and nested dissection.

An order is (node, rank). The elimination tree is (id, parent): a vertex's parent is the lowest-ranked vertex above it
that is next to its component among the vertices ranked up to it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut_plan
from .components import connected_components
from .graph import Graph, numbered
from .mst import spanning_forest
from .trees import depths


def invert_order(order: DataFrame) -> DataFrame:
    """(node, rank) with the roles changed."""
    return order.select(F.col("rank").alias("node"), F.col("node").alias("rank"))


def orient_by_rank(g: Graph, order: DataFrame) -> DataFrame:
    """(src, dst) from lower to higher rank; self-loops go."""
    r = order.select("node", "rank")
    e = g.edges.select("src", "dst").join(r.toDF("src", "rs"), "src").join(r.toDF("dst", "rd"), "dst")
    return e.where("rs < rd").select("src", "dst").distinct()


def elimination_tree(g: Graph, order: DataFrame) -> DataFrame:
    """(id, parent, rank); parent null at roots.

    Which vertices ranked up to r are connected depends only on a minimum spanning forest by the larger rank of an edge's
    ends, so edges are first reduced to one less than vertices by distributed rounds; then each component is one group:
    its forest's edges by weight join union-find sets, whose highest vertex gets the new one as its parent.
    """
    r = order.select("node", "rank")
    e = g.canonical().select("src", "dst").join(r.toDF("src", "rs"), "src").join(r.toDF("dst", "rd"), "dst")
    forest = cut_plan(spanning_forest(e.select(F.col("rs").alias("src"), F.col("rd").alias("dst"), F.greatest("rs", "rd").alias("w"))))
    names = connected_components(Graph.from_edges(forest.select("src", "dst"))).select(F.col("id").alias("src"), "component")

    def run(rows: pa.Table) -> pa.Table:
        pairs = sorted((max(a, b), min(a, b)) for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True))
        top: dict[int, int] = {}
        parent: dict[int, int] = {}
        for high, low in pairs:
            at = low
            path = []
            while at in top and top[at] != at:
                path.append(at)
                at = top[at]
            for p in path:
                top[p] = high
            if at != high:
                parent[at] = high
                top[at] = high
            top.setdefault(high, high)
        return pa.table({"child": pa.array(list(parent), pa.int64()), "up": pa.array(list(parent.values()), pa.int64())})

    links = forest.join(names, "src").groupBy("component").applyInArrow(run, "child long, up long")
    back = r.toDF("up_node", "up")
    return r.join(links, r["rank"] == links["child"], "left").join(back, "up", "left").select(F.col("node").alias("id"), F.col("up_node").alias("parent"), "rank")


def _per_root(tree: DataFrame, walk: Callable[[int, dict[int, list[int]], dict[int, int]], list[tuple]], schema: str) -> DataFrame:
    """Run walk(root, children, subtree sizes) on each tree of the forest; trees run in parallel.

    Elimination trees are about as deep as separators are large, so a tree is walked in memory, one group for each.
    """
    rows = tree.select("id", "parent").join(depths(tree.select("id", "parent")), "id")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("depth", "ascending"), ("id", "ascending")])
        ids, parents = rows["id"].to_pylist(), rows["parent"].to_pylist()
        children: dict[int, list[int]] = {i: [] for i in ids}
        size = dict.fromkeys(ids, 1)
        for i, p in zip(ids, parents, strict=True):
            if p is not None:
                children[p].append(i)
        for i, p in zip(reversed(ids), reversed(parents), strict=True):
            if p is not None:
                size[p] += size[i]
        made = walk(ids[0], children, size)
        return pa.table({n: pa.array([m[k] for m in made], pa.int64()) for k, n in enumerate(names)})

    return rows.groupBy("root").applyInArrow(run, schema)


def separator_sizes(tree: DataFrame, least: int = 10, share: float = 0.1) -> DataFrame:
    """(root, node, n, s): sizes of parts and of their separators, read off the tree.

    From each root down: children of more than max(least, floor(share * size)) are large. One large child goes on with
    s + 1; several close a separator, n = size + s, and begin anew with s = 1 in each; none ends the walk. (n counts the
    branching vertex in both terms.)
    """

    def walk(root: int, children: dict[int, list[int]], size: dict[int, int]) -> list[tuple]:
        out, stack = [], [(root, 1)]
        while stack:
            node, s = stack.pop()
            large = [c for c in children[node] if size[c] > max(least, int(share * size[node]))]
            if len(large) > 1:
                out.append((root, node, size[node] + s, s))
            stack += [(c, s + 1 if len(large) == 1 else 1) for c in large]
        return out

    return _per_root(tree, walk, "root long, node long, n long, s long")


def top_level_separator(tree: DataFrame, share: int = 20) -> DataFrame:
    """(root, step, node): from each root down while exactly one child is larger than floor(size / share)."""

    def walk(root: int, children: dict[int, list[int]], size: dict[int, int]) -> list[tuple]:
        out, at = [(root, 0, root)], root
        while True:
            large = [c for c in children[at] if size[c] > size[at] // share]
            if len(large) != 1:
                return out
            at = large[0]
            out.append((root, len(out), at))

    return _per_root(tree, walk, "root long, step long, node long")


# inertial node separators


def min_vertex_cut(adj: list[list[int]], sources: list[int], sinks: list[int]) -> list[int]:
    """A least set of vertices that all paths from sources to sinks cross, ends included; of all such sets the one nearest to the sources.

    Disjoint paths grow in turns, each a depth-first search from all sources that enters no place twice and tries
    neighbours nearer to the sinks first. A vertex v is a place v before it and a place v + n behind it, with room for one
    path between; back[v] is the vertex before v on its path, -1 off all paths, -2 where one starts. Only sources next to
    other vertices start paths, and none goes through a source again. A turn without a new path has entered all that can
    be reached.
    """
    n = len(adj)
    first, last = bytearray(n), bytearray(n)
    for s in sources:
        first[s] = 1
    far = [n] * n
    for t in sinks:
        last[t], far[t] = 1, 0
    layer, depth = list(sinks), 0
    while layer:
        depth += 1
        ahead = []
        for v in layer:
            for w in adj[v]:
                if far[w] == n:
                    far[w] = depth
                    if not first[w]:
                        ahead.append(w)
        layer = ahead
    near: list[list[int]] = [sorted((w for w in x if not first[w]), key=far.__getitem__) for x in adj]
    starts = [s for s in dict.fromkeys(sources) if last[s] or near[s]]
    back = [-1] * n
    while True:
        seen = bytearray(2 * n)
        for s in starts:
            seen[s] = 1
        at = [0] * n
        grown = False
        for s in starts:
            path = [s]
            while path:
                a = path[-1]
                if a < n:
                    p = back[a]
                    b = a + n if p == -1 else p + n
                    if p != -2 and not seen[b]:
                        seen[b] = 1
                        path.append(b)
                    else:
                        path.pop()
                    continue
                v = a - n
                if last[v]:
                    break
                k, x = at[v], near[v]
                while k < len(x) and seen[x[k]]:
                    k += 1
                at[v] = k
                if k < len(x):
                    b = x[k]
                elif back[v] != -1 and not seen[v]:
                    b = v
                else:
                    path.pop()
                    continue
                seen[b] = 1
                path.append(b)
            if path:
                grown = True
                back[s] = -2
                for a, b in zip(path, path[1:], strict=False):
                    if a >= n:
                        back[b] = -1 if b == a - n else a - n
        if not grown:
            return [v for v in range(n) if seen[v] and not seen[v + n]]


def _parts_without(adj: list[list[int]], cut: set[int]) -> list[list[int]]:
    seen, out = set(cut), []
    for s in range(len(adj)):
        if s not in seen:
            seen.add(s)
            part, queue = [s], deque([s])
            while queue:
                for w in adj[queue.popleft()]:
                    if w not in seen:
                        seen.add(w)
                        part.append(w)
                        queue.append(w)
            out.append(sorted(part))
    return out


def _line_order(adj: list[list[int]], xy: np.ndarray | None, k: int) -> list[int]:
    """Vertices along one of four directions, or by breadth-first layers from an end if there are no positions."""
    n = len(adj)
    if xy is not None:
        d = ((1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, -1.0))[k]
        return np.argsort(xy[:, 0] * d[0] + xy[:, 1] * d[1], kind="stable").tolist()
    start = 0
    order: list[int] = []
    for _ in range(2):
        seen, order = {start}, [start]
        for v in order:
            for w in adj[v]:
                if w not in seen:
                    seen.add(w)
                    order.append(w)
        order += [v for v in range(n) if v not in seen]
        start = order[len(seen) - 1]
    return order


def inertial_separator(adj: list[list[int]], xy: np.ndarray | None, imbalance: float = 0.33) -> list[int]:
    """The smallest of the least cuts between the first and last shares (a quarter and more) along some directions, among those with parts of at most (1 + imbalance) / 2 of the vertices; else the smallest largest part decides."""
    n, best = len(adj), None
    for k in range(4 if xy is not None else 1):
        order = _line_order(adj, xy, k)
        for share in (0.25, 0.35, 0.45):
            end = max(1, int(n * share))
            cut = min_vertex_cut(adj, order[:end], order[-end:])
            largest = max((len(p) for p in _parts_without(adj, set(cut))), default=0)
            fits = largest <= (1 + imbalance) / 2 * n
            score = (not fits, len(cut) if fits else largest, largest)
            if best is None or score < best[0]:
                best = (score, cut)
            if fits:
                break
    return best[1] if best else []


def node_separator(g: Graph, imbalance: float = 0.33) -> DataFrame:
    """(component, id): a balanced separator of each component."""
    return _by_part(g, connected_components(g), imbalance)


WHOLE = 20_000  # parts of so many vertices at most are taken apart to the end by one task


def _cut(adj: list[list[int]], xy: np.ndarray | None, imbalance: float) -> list[int]:
    return inertial_separator(adj, xy, imbalance) if len(adj) > 2 else [0]


def _recursion(adj: list[list[int]], xy: np.ndarray | None, least: int, imbalance: float) -> Iterator[tuple[tuple[int, ...], list[int], list[int] | None]]:
    """(above, part, cut) of a connected part and of all that it falls into: the first vertices of the parts around it, its vertices and its separator, None where it has at most `least` vertices."""
    stack: list[tuple[tuple[int, ...], list[int]]] = [((), list(range(len(adj))))]
    while stack:
        above, part = stack.pop()
        if len(part) <= least:
            yield above, part, None
            continue
        place = {v: i for i, v in enumerate(part)}
        inner = [[place[w] for w in adj[v] if w in place] for v in part]
        cut = _cut(inner, None if xy is None else xy[part], imbalance)
        yield above, part, [part[i] for i in cut]
        stack += [((*above, part[0]), [part[i] for i in p]) for p in _parts_without(inner, set(cut))]


def _lists(g: Graph, parts: DataFrame) -> DataFrame:
    """Rows of parts (id, component, ..) with their neighbours in the same part, and positions if there are any."""
    names = parts.select("id", "component")
    e = g.edges.select("src", "dst").join(names.select(F.col("id").alias("src"), "component"), "src").join(names.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    lists = e.groupBy("component", F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
    placed = "x" in g.vertices.columns
    return parts.join(lists, ["component", "id"], "left").join(g.vertices.select("id", *(("x", "y") if placed else ())), "id")


def _read(rows: pa.Table) -> tuple[pa.Table, list[int], list[list[int]], np.ndarray | None]:
    """A part's rows by id, its ids, adjacency lists of places, and positions."""
    rows = rows.sort_by("id")
    ids = rows["id"].to_pylist()
    place = {v: i for i, v in enumerate(ids)}
    adj = [[place[w] for w in near or ()] for near in rows["near"].to_pylist()]
    return rows, ids, adj, np.c_[rows["x"].to_numpy(), rows["y"].to_numpy()] if "x" in rows.column_names else None


def _by_part(g: Graph, parts: DataFrame, imbalance: float) -> DataFrame:
    """(component, id): a separator of each part (id, component); one group a part."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, ids, adj, xy = _read(rows)
        cut = [ids[i] for i in _cut(adj, xy, imbalance)]
        return pa.table({"component": pa.array([key[0].as_py()] * len(cut), pa.int64()), "id": pa.array(cut, pa.int64())})

    return _lists(g, parts.select("id", "component")).groupBy("component").applyInArrow(run, "component long, id long")


def _dissected(g: Graph, parts: DataFrame, leaf: int, imbalance: float) -> DataFrame:
    """(id, key) of parts (id, component, path) taken apart to the end, one group a part."""

    def run(rows: pa.Table) -> pa.Table:
        rows, ids, adj, xy = _read(rows)
        degree, path = rows["degree"].to_pylist(), rows["path"][0].as_py()
        found, keys = [], []
        for above, part, cut in _recursion(adj, xy, leaf, imbalance):
            at = [*path, *(k for v in above for k in (ids[v], 0)), ids[part[0]]]
            found += [ids[v] for v in (part if cut is None else cut)]
            keys += [[*at, 0, degree[v], ids[v]] for v in part] if cut is None else [[*at, 1, ids[v]] for v in cut]
        return pa.table({"id": pa.array(found, pa.int64()), "key": pa.array(keys, pa.list_(pa.int64()))})

    return _lists(g, parts).join(g.degrees(), "id").groupBy("component").applyInArrow(run, "id long, key array<long>")


def _separated(g: Graph, parts: DataFrame, least: int, level: int, imbalance: float) -> DataFrame:
    """(n, s, level) of parts (id, component) separated to the end, one group a part."""

    def run(rows: pa.Table) -> pa.Table:
        _, _, adj, xy = _read(rows)
        made = [(len(part), len(cut), level + len(above)) for above, part, cut in _recursion(adj, xy, least, imbalance) if cut is not None]
        return pa.table({c: pa.array([m[k] for m in made], kind) for k, (c, kind) in enumerate((("n", pa.int64()), ("s", pa.int64()), ("level", pa.int32())))})

    return _lists(g, parts.select("id", "component")).groupBy("component").applyInArrow(run, "n long, s long, level int")


def nested_dissection(g: Graph, leaf: int = 50, imbalance: float = 0.33, max_rounds: int = 64, whole: int = WHOLE) -> DataFrame:
    """(node, rank): separators last, parts before them, recursively; parts of at most `leaf` by degree.

    Every round separates all parts at once, one group each, so parts run in parallel; only the first rounds have few.
    Parts of at most `whole` vertices are taken apart to the end where they are, which gives the same order.
    """
    path = connected_components(g).select("id", "component", F.array().cast("array<long>").alias("path"))
    left, done = cut_plan(path), []
    for _ in range(max_rounds):
        sizes = left.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        small = left.join(sizes.where(F.col("n") <= leaf), "component")
        deg = g.degrees()
        done.append(small.join(deg, "id").select("id", F.concat("path", F.array("component", F.lit(0).cast("long"), F.col("degree").cast("long"), F.col("id"))).alias("key")))
        middle = left.join(sizes.where((F.col("n") > leaf) & (F.col("n") <= whole)).select("component"), "component", "left_semi")
        done.append(cut_plan(_dissected(g, middle.select("id", "component", "path"), leaf, imbalance)))
        big = cut_plan(left.join(sizes.where(F.col("n") > max(leaf, whole)).select("component"), "component", "left_semi").select("id", "component", "path"))
        if big.isEmpty():
            break
        part = g.induced(big.select("id"))
        cut = cut_plan(_by_part(part, big, imbalance).select("id").withColumn("cut", F.lit(True)))
        marked = big.join(cut, "id", "left")
        done.append(marked.where("cut").select("id", F.concat("path", F.array(F.col("component"), F.lit(1).cast("long"), F.col("id"))).alias("key")))
        rest = marked.where("cut IS NULL").select("id", F.concat("path", F.array(F.col("component"), F.lit(0).cast("long"))).alias("path"))
        left = cut_plan(connected_components(part.without_vertices(cut)).join(rest, "id").select("id", "component", "path"))
    total = done[0]
    for d in done[1:]:
        total = total.union(d)
    ranked = numbered(total, ["key"], "rank")
    return ranked.select(F.col("id").alias("node"), "rank")


def separate_recursively(g: Graph, least: int = 100, follow: str = "all", most: int | None = None, imbalance: float = 0.33, whole: int = WHOLE) -> DataFrame:
    """(n, s, level): sizes of parts of more than `least` vertices and of their separators, level by level.

    If all parts are followed, those of at most `whole` vertices are separated to the end where they are.

    follow: 'all' parts of a level, its 'largest' one, or its 'first' one (that with the smallest id). With most, parts
    wait in a queue, those of one part by their smallest ids, and the first so many are separated.
    """
    out, level, seen = [], 0, 0
    parts = cut_plan(connected_components(g).withColumn("turn", F.lit(0).cast("long")))
    while True:
        sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("turn")).where(F.col("n") > least)
        if follow != "all":
            sizes = sizes.orderBy(*([F.desc("n")] if follow == "largest" else []), "component").limit(1)
        if most is not None:
            sizes = sizes.orderBy("turn", "component").limit(most - seen)
        if follow == "all" and most is None:
            middle = sizes.where(F.col("n") <= whole).select("component")
            out.append(cut_plan(_separated(g, parts.join(middle, "component", "left_semi"), least, level, imbalance)))
            sizes = sizes.where(F.col("n") > whole)
        sizes = cut_plan(sizes)
        k = sizes.count()
        if not k:
            break
        seen += k
        big = cut_plan(parts.drop("turn").join(sizes, "component").select("id", "component"))
        part = g.induced(big.select("id"))
        cut = cut_plan(_by_part(part, big, imbalance))
        out.append(cut.groupBy("component").agg(F.count(F.lit(1)).alias("s")).join(sizes, "component").select("n", "s", F.lit(level).alias("level")))
        if most is not None and seen >= most:
            break
        queue = sizes.select("component", F.lit(0).cast("long").alias("turn")) if most is None else sizes.select("component", (F.row_number().over(Window.orderBy("turn", "component"))).cast("long").alias("turn"))
        turns = big.join(queue, "component").select("id", "turn")
        parts = cut_plan(connected_components(part.without_vertices(cut.select("id"))).join(turns, "id"))
        level += 1
    if not out:
        return parts.select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("level")).limit(0)
    total = out[0]
    for o in out[1:]:
        total = total.union(o)
    return total


def _eccentricity(adj: list[list[int]], start: int) -> list[list[int]]:
    """Breadth-first layers."""
    seen, layers = {start}, [[start]]
    while True:
        layer = list(dict.fromkeys(w for v in layers[-1] for w in adj[v] if w not in seen))
        if not layer:
            return layers
        seen.update(layer)
        layers.append(layer)


def part_diameter(adj: list[list[int]]) -> int:
    """Exact hop diameter of a connected part: fringes of a central vertex from the outside in, until nothing beyond can be longer."""
    a = _eccentricity(adj, max(range(len(adj)), key=lambda v: len(adj[v])))[-1][0]
    layers = _eccentricity(adj, a)
    best, at = len(layers) - 1, layers[-1][0]
    for layer in reversed(layers[len(layers) // 2 : -1]):  # half-way back along a longest path from a
        at = next(v for v in adj[at] if v in set(layer))
    layers = _eccentricity(adj, at)
    for k in range(len(layers) - 1, 0, -1):
        if 2 * k <= best:
            break
        best = max(best, *(len(_eccentricity(adj, v)) - 1 for v in layers[k]))
    return best


def recursive_diameters(g: Graph, least: int = 100, imbalance: float = 0.33) -> DataFrame:
    """(n, diameter, level): size and exact hop diameter of each part when the largest part of more than `least` vertices is separated again and again; level 0 is the largest component itself. One task a part."""
    out, level = [], 0
    parts = cut_plan(connected_components(g))
    top = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    parts = cut_plan(parts.join(top, "component", "left_semi").select("id", "component"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_pylist()
        place = {v: i for i, v in enumerate(ids)}
        adj = [[place[w] for w in near or ()] for near in rows["near"].to_pylist()]
        return pa.table({"component": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "diameter": pa.array([part_diameter(adj)], pa.int64())})

    while True:
        part = g.induced(parts.select("id"))
        lists = part.edges.join(parts.withColumnRenamed("id", "src"), "src").join(parts.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("near"))
        found = cut_plan(parts.join(lists, "id", "left").groupBy("component").applyInArrow(run, "component long, n long, diameter long"))
        out.append(found.select("n", "diameter", F.lit(level).alias("level")))
        largest = found.orderBy(F.desc("n"), "component").limit(1).where(F.col("n") > least).select("component")
        big = cut_plan(parts.join(largest, "component", "left_semi").select("id", "component"))
        if big.isEmpty():
            break
        part = g.induced(big.select("id"))
        parts = cut_plan(connected_components(part.without_vertices(_by_part(part, big, imbalance).select("id"))))
        level += 1
        if parts.isEmpty():
            break
    total = out[0]
    for o in out[1:]:
        total = total.union(o)
    return total


def separator_extension(g: Graph, separator: DataFrame) -> DataFrame:
    """One row: edges, length and number of the separator's part, and what is left without it."""
    part = g.induced(separator)
    left = connected_components(g.without_vertices(separator)).agg(F.countDistinct("component").alias("parts"))
    return part.edge_lengths().agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("length")).crossJoin(separator.agg(F.count(F.lit(1)).alias("size"))).crossJoin(left)
