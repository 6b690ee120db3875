"""Sequential parts of the generators, each for one sample in one task."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.triangulate import Triangulation, orient

Edges = list[tuple[int, int]]

# deterministic families


def nested_grid(width: int, levels: int) -> tuple[list[tuple[int, float, float]], Edges]:
    """Vertices and edges. A refined cell keeps its corners and adds width^2 - 4 vertices of its own."""
    vertices: list[tuple[int, float, float]] = []
    edges: Edges = []

    def new(x: float, y: float) -> int:
        vertices.append((len(vertices), x, y))
        return len(vertices) - 1

    last = width - 1
    corners = [new(float(x), float(y)) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
    cells = [tuple(corners)]
    for _ in range(levels):
        finer = []
        for a, b, c, d in cells:
            own = {(0, 0): a, (last, 0): b, (0, last): c, (last, last): d}
            for i in range(width):
                for j in range(width):
                    if (i, j) not in own:
                        s, t = i / last, j / last
                        at = [(1 - s) * (1 - t) * vertices[a][k] + s * (1 - t) * vertices[b][k] + (1 - s) * t * vertices[c][k] + s * t * vertices[d][k] for k in (1, 2)]
                        own[i, j] = new(*at)
            for i in range(width):
                for j in range(width):
                    if i < last:
                        edges.append((own[i, j], own[i + 1, j]))
                    if j < last:
                        edges.append((own[i, j], own[i, j + 1]))
                    if i < last and j < last:
                        finer.append((own[i, j], own[i + 1, j], own[i, j + 1], own[i + 1, j + 1]))
        cells = finer
    return vertices, edges


def cbrt_maximal(n: int) -> tuple[int, Edges]:
    """Number of vertices and edges; the two halves are equal, so one is built and moved."""
    if n <= 2:
        return 1, []
    k = round(n ** (1 / 3))
    k -= k**3 > n
    half, inner = cbrt_maximal((n - k) // 2)
    clique = [(i, j) for i in range(k) for j in range(i + 1, k)]
    parts = [(k + s * half + a, k + s * half + b) for s in (0, 1) for a, b in inner]
    return k + 2 * half, clique + parts + [(i, k + j) for i in range(k) for j in range(2 * half)]


def super_grid_width(size: int, count: int) -> int:
    """Least w with w^3 >= w^2 + count (size - 4): then the grid with `count` refined cells, corners counted once, has about w^3 vertices."""
    w = 1
    while w**3 - w**2 < count * (size - 4):
        w += 1
    return w


# random families


def prufer_tree(n: int, seed: int) -> Edges:
    """A uniform random labelled tree on 0..n-1."""
    if n < 2:
        return []
    code = np.random.default_rng(seed).integers(0, n, n - 2).tolist()
    left = [1] * n
    for c in code:
        left[c] += 1
    edges, leaf = [], 0
    while left[leaf] != 1:
        leaf += 1
    at = leaf
    for c in code:
        edges.append((at, c))
        left[c] -= 1
        if left[c] == 1 and c < leaf:
            at = c
        else:
            leaf += 1
            while left[leaf] != 1:
                leaf += 1
            at = leaf
    edges.append((at, n - 1))
    return edges


def _perlin(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Gradient noise: smoothly blended dot products with unit gradients hashed from the lattice corners."""
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = x - x0, y - y0

    def corner(dx: int, dy: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (x0 + dx).astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y0 + dy).astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(seed * 0x165667B1 + 1)
            h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ h >> np.uint64(32)
        a = h.astype(np.float64) * (2 * math.pi / 2**64)
        return np.cos(a) * (fx - dx) + np.sin(a) * (fy - dy)

    u, v = (t * t * t * (t * (t * 6 - 15) + 10) for t in (fx, fy))
    low = corner(0, 0) * (1 - u) + corner(1, 0) * u
    high = corner(0, 1) * (1 - u) + corner(1, 1) * u
    return (low * (1 - v) + high * v) * math.sqrt(2)


def noise_accepts(x: Column, y: Column, u: Column, scales: list[float], seed: int, mode: str = "product") -> Column:
    """product: the product of the octaves, each moved to 0..1, exceeds 0.5^k. root: its k-th root exceeds u. pink: the octaves' sum, halved each time, exceeds u."""

    @F.pandas_udf("boolean")
    def accepts(x: pd.Series, y: pd.Series, u: pd.Series) -> pd.Series:
        a, b = x.to_numpy(), y.to_numpy()
        octaves = [_perlin(a * s + 3 * s, b * s + 3 * s, seed) * 0.5 + 0.5 for s in scales]
        if mode == "pink":
            return pd.Series(sum(o / 2 ** (i + 1) for i, o in enumerate(octaves)) > u)
        product = np.prod(octaves, axis=0)
        return pd.Series(product > 0.5 ** len(scales) if mode == "product" else np.maximum(product, 0) ** (1 / len(scales)) > u)

    return accepts(x, y, u)


def delaunay_of_group(rows: pa.Table) -> pa.Table:
    """Coordinate edges of the Delaunay triangulation of a group's points."""
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    e = np.array(Triangulation(x, y).edges(), np.int64).reshape(-1, 2)
    return pa.table({"ux": x[e[:, 0]], "uy": y[e[:, 0]], "vx": x[e[:, 1]], "vy": y[e[:, 1]]})


def thin_to_degrees(n: int, edges: Edges, target: dict[int, float], seed: int, slack: float = 1.0) -> Edges:
    """Random edges go at vertices of a degree that too many have, from the largest degree down to 2, until slack times its share is left.

    Each draw takes a random vertex of the degree and a random neighbour of it.
    """
    rng = np.random.default_rng(seed)
    near: list[dict[int, None]] = [{} for _ in range(n)]
    for a, b in edges:
        near[a][b] = near[b][a] = None
    top = max((len(x) for x in near), default=0)
    having: list[list[int]] = [[] for _ in range(top + 1)]
    place = [0] * n

    def put(v: int) -> None:
        d = len(near[v])
        place[v] = len(having[d])
        having[d].append(v)

    def take(v: int) -> None:
        row = having[len(near[v])]
        last = row.pop()
        if last != v:
            row[place[v]], place[last] = last, place[v]

    for v in range(n):
        put(v)
    for d in range(top, 1, -1):
        while having[d] and len(having[d]) > slack * int(target.get(d, 0.0) * n):
            v = having[d][int(rng.integers(len(having[d])))]
            u = list(near[v])[int(rng.integers(d))]
            take(v)
            take(u)
            del near[v][u], near[u][v]
            put(v)
            put(u)
    return [(a, b) for a in range(n) for b in near[a] if a < b]


#: Shares of degrees 1 to 4 in the grid family, and of degrees 1 to 5 in a German road network.
GRID_DEGREES = {1: 0.08, 2: 0.55, 3: 0.15, 4: 0.22}
ROAD_DEGREES = {1: 0.2193, 2: 0.1465, 3: 0.5506, 4: 0.0818, 5: 0.0017}


def grid_degrees(size: int, seed: int) -> tuple[np.ndarray, Edges]:
    """A square lattice thinned to GRID_DEGREES."""
    k = math.isqrt(size)
    edges = [(i * k + j, i * k + j + 1) for i in range(k) for j in range(k - 1)] + [(i * k + j, (i + 1) * k + j) for i in range(k - 1) for j in range(k)]
    return np.array([(i, j) for i in range(k) for j in range(k)], float), thin_to_degrees(k * k, edges, GRID_DEGREES, seed)


def _hull(points: np.ndarray, ids: list[int]) -> list[int]:
    """Convex hull, counter-clockwise."""
    order = sorted(ids, key=lambda i: (points[i, 0], points[i, 1]))

    def chain(seq: list[int]) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1 and orient(*points[out[-2]], *points[out[-1]], *points[i]) <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    return chain(order) + chain(order[::-1]) if len(order) > 2 else order


def concave_hull(points: np.ndarray, ids: list[int], concavity: float = 2.0) -> list[int]:
    """A ring around all points that follows them inwards: a side goes to the inner point nearest to it and on, if that is nearer than the side's length over the concavity, no nearer to the sides next to it, and seen from both ends.

    No point comes to lie outside: the triangle between a side and the point nearest to it is empty.
    """
    ring = _hull(points, ids)
    if len(ring) < 3:
        return ring
    after = dict(zip(ring, ring[1:] + ring[:1], strict=True))
    before = {b: a for a, b in after.items()}
    inner = np.array(sorted(set(ids) - set(ring)), int)
    sides = deque(after.items())

    def distance(p: np.ndarray, a: int, b: int) -> np.ndarray:
        u, v = points[a], points[b]
        w = v - u
        t = np.clip(((p - u) @ w) / max(float(w @ w), 1e-300), 0, 1)
        return np.hypot(*(p - u - t[:, None] * w).T)

    while sides and len(inner):
        a, b = sides.popleft()
        d = distance(points[inner], a, b)
        k = int(d.argmin())
        p = int(inner[k])
        at = points[[p]]
        if d[k] * concavity > math.dist(points[a], points[b]) or d[k] > min(distance(at, before[a], a)[0], distance(at, b, after[b])[0]):
            continue
        whole = [a]
        while after[whole[-1]] != a:
            whole.append(after[whole[-1]])
        if not (_sees(points, a, p, whole) and _sees(points, p, b, whole)):
            continue
        after[a], after[p], before[p], before[b] = p, b, a, p
        inner = np.delete(inner, k)
        sides += [(a, p), (p, b)]
    out = [ring[0]]
    while after[out[-1]] != ring[0]:
        out.append(after[out[-1]])
    return out


def _sees(points: np.ndarray, a: int, b: int, hull: list[int]) -> bool:
    """Whether the segment a-b crosses no side of the hull but at a or b."""
    for p, q in zip(hull, hull[1:] + hull[:1], strict=True):
        if {a, b} & {p, q}:
            continue
        if orient(*points[a], *points[b], *points[p]) * orient(*points[a], *points[b], *points[q]) < 0 and orient(*points[p], *points[q], *points[a]) * orient(*points[p], *points[q], *points[b]) < 0:
            return False
    return True


def bridged_blobs(size: int, seed: int) -> tuple[np.ndarray, Edges]:
    """Normal blobs of about 80 points with a Delaunay graph each, merged along a spanning tree of their centres; each merge adds 2 floor(cbrt n) bridges between corners of concave hulls that see each other."""
    rng = np.random.default_rng(seed)
    sizes: list[int] = []
    while sum(sizes) < size:
        sizes.append(max(4, int(rng.normal(80, 20))))
    centres = rng.uniform(0, 1, (len(sizes), 2))
    spread = 0.25 / math.sqrt(len(sizes))
    points = np.concatenate([rng.normal(c, spread, (s, 2)) for c, s in zip(centres, sizes, strict=True)])
    edges, members, at = [], [], 0
    for s in sizes:
        members.append(list(range(at, at + s)))
        edges += [(a + at, b + at) for a, b in Triangulation(points[at : at + s, 0], points[at : at + s, 1]).edges()]
        at += s
    part = list(range(len(sizes)))
    links = Triangulation(centres[:, 0], centres[:, 1]).edges() if len(sizes) > 1 else []
    for _, a, b in sorted((float(((centres[a] - centres[b]) ** 2).sum()), a, b) for a, b in links):
        p, q = part[a], part[b]
        if p == q:
            continue
        hp, hq = concave_hull(points, members[p]), concave_hull(points, members[q])
        pairs = [(u, v) for u in hp for v in hq if _sees(points, u, v, hp) and _sees(points, u, v, hq)] or [min(((u, v) for u in hp for v in hq), key=lambda e: ((points[e[0]] - points[e[1]]) ** 2).sum())]
        merged = members[p] + members[q]
        k = min(len(pairs), 2 * int(round(len(merged) ** (1 / 3), 9)))
        edges += [pairs[i] for i in rng.choice(len(pairs), k, replace=False).tolist()]
        members[p] = merged
        part = [p if x == q else x for x in part]
    return points, edges


Polygon = list[tuple[float, float]]


def area(poly: Polygon) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1], strict=True))) / 2


def clip(poly: Polygon, nx: float, ny: float, c: float) -> Polygon:
    """The part of a convex polygon with nx x + ny y <= c."""
    out = []
    for a, b in zip(poly, poly[1:] + poly[:1], strict=True):
        da, db = nx * a[0] + ny * a[1] - c, nx * b[0] + ny * b[1] - c
        if da <= 0:
            out.append(a)
        if da * db < 0:
            t = da / (da - db)
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def voronoi_cells(poly: Polygon, sites: np.ndarray) -> list[Polygon]:
    """Cells of the sites within a convex polygon: it is cut by the bisectors towards Delaunay neighbours."""
    if len(sites) < 3:
        return []
    near = defaultdict(list)
    for a, b in Triangulation(sites[:, 0], sites[:, 1]).edges():
        near[a].append(b)
        near[b].append(a)
    out = []
    for i, (x, y) in enumerate(sites.tolist()):
        cell = poly
        for j in near[i]:
            nx, ny = sites[j, 0] - x, sites[j, 1] - y
            cell = clip(cell, nx, ny, (sites[j, 0] ** 2 - x * x + sites[j, 1] ** 2 - y * y) / 2)
            if len(cell) < 3:
                break
        if len(cell) >= 3:
            out.append(cell)
    return out


def _random_in(poly: Polygon, n: int, rng: np.random.Generator) -> np.ndarray:
    """Uniform points of a convex polygon: a fan triangle by area, then a point of it."""
    tri = [(poly[0], b, c) for b, c in zip(poly[1:], poly[2:], strict=False)]
    w = np.array([area(list(t)) for t in tri])
    pick = rng.choice(len(tri), n, p=w / w.sum())
    r, s = np.sqrt(rng.random(n)), rng.random(n)
    t = np.array(tri)[pick]
    return t[:, 0] * (1 - r)[:, None] + t[:, 1] * (r * (1 - s))[:, None] + t[:, 2] * (r * s)[:, None]


def voronoi_roads(size: int, seed: int, levels: tuple[tuple[float, int, int], ...] | None = None) -> tuple[np.ndarray, Edges]:
    """Sides of Voronoi cells: on each level (fraction, least, most) the smallest floor(fraction (k - 1)) + 1 cells are divided by a random number of sites."""
    rng = np.random.default_rng(seed)
    levels = levels or ((1.0, max(4, size // 40), max(5, size // 40 + 1)), (0.9, 4, 12))
    cells: list[Polygon] = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    index: dict[tuple[int, int], int] = {}
    points: list[tuple[float, float]] = []
    edges: dict[tuple[int, int], None] = {}

    def number(p: tuple[float, float]) -> int:
        key = (round(p[0] * 1e8), round(p[1] * 1e8))
        if key not in index:
            index[key] = len(points)
            points.append(p)
        return index[key]

    for fraction, least, most in levels:
        if not cells:
            break
        small = sorted(cells, key=area)[: int(fraction * (len(cells) - 1)) + 1]
        cells = [c for p in small if area(p) > 0 for c in voronoi_cells(p, _random_in(p, int(rng.integers(least, most + 1)), rng))]
        for c in cells:
            ids = [number(p) for p in c]
            edges.update({(min(a, b), max(a, b)): None for a, b in zip(ids, ids[1:] + ids[:1], strict=True) if a != b})
    return np.array(points, float).reshape(-1, 2), list(edges)


def highway(size: int, seed: int, levels: int = 25) -> tuple[np.ndarray, Edges]:
    """Incremental cover: level i holds centres 2^(i+1) apart. A new point is put on all levels below the first whose centres are near it; it joins their centres within sqrt 2 times their reach, and its nearest centre of that level."""
    rng = np.random.default_rng(seed)
    side = 10_000.0
    points: list[tuple[float, float]] = []
    while len(points) < size:
        centre = rng.uniform((0, 0), (side, 0.75 * side))
        radius = rng.exponential(0.05 * side)
        for _ in range(min(size - len(points), 1 + int(radius**1.1))):
            d, a = rng.normal(0, radius), rng.uniform(0, 2 * math.pi)
            points.append((centre[0] + d * math.cos(a), centre[1] + d * math.sin(a)))
    order = rng.permutation(len(points)).tolist()
    p = np.array(points)[order]
    reach = [2.0 ** (i + 1) for i in range(levels)]
    grid: list[dict[tuple[int, int], list[int]]] = [defaultdict(list) for _ in range(levels)]
    edges: dict[tuple[int, int], None] = {}

    def around(level: int, i: int, r: float) -> list[tuple[float, int]]:
        s = math.sqrt(2) * reach[level]
        cx, cy = int(p[i, 0] // s), int(p[i, 1] // s)
        found = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in grid[level].get((cx + dx, cy + dy), ())]
        return sorted((d, j) for j in found if (d := math.dist(p[i], p[j])) <= r)

    for i in range(len(p)):
        level = next((k for k in range(levels) if around(k, i, reach[k])), levels)
        for k in range(level):
            s = math.sqrt(2) * reach[k]
            edges.update({(j, i): None for d, j in around(k, i, s) if d < s})
            grid[k][int(p[i, 0] // s), int(p[i, 1] // s)].append(i)
        if level < levels:
            edges[around(level, i, reach[level])[0][1], i] = None
    return p, list(edges)


FAMILIES: dict[str, Callable[[int, int], tuple[np.ndarray, Edges]]] = {"grid_degrees": grid_degrees, "bridged": bridged_blobs, "voronoi": voronoi_roads, "highway": highway}


def family_rows(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vertices (kind 0: id, -, x, y) and edges (kind 1: src, dst) of each (run_id, size, seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, size, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, e = FAMILIES[name](size, seed)
                pairs = np.array(e, np.int64).reshape(-1, 2)
                n, m = len(p), len(pairs)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([0] * n + [1] * m, pa.int32()), "a": pa.array(np.r_[np.arange(n), pairs[:, 0]], pa.int64()), "b": pa.array(np.r_[np.zeros(n, np.int64), pairs[:, 1]], pa.int64()),
                    "x": pa.array(np.r_[p[:, 0], np.zeros(m)]), "y": pa.array(np.r_[p[:, 1], np.zeros(m)]),
                })

    return run


def family_counts(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(run_id, n, m) of each (run_id, size, seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(run_id, *(len(x) for x in FAMILIES[name](size, seed))) for run_id, size, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["run_id", "n", "m"])

    return run
