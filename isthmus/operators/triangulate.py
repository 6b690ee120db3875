"""Delaunay triangulation of points held in memory: incremental insertion with exact predicates.

A directed edge (u, v) maps to the third corner of the counter-clockwise triangle on its left; GHOST stands beyond the
hull, so hull edges have triangles on both sides and no case differs.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1
EPS = 2.0**-53


def orient(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Positive if a, b, c turn left; the sign is exact."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det = left - right
    if abs(det) > 4 * EPS * (abs(left) + abs(right)):
        return det
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (d > 0) - (d < 0)


def in_circle(ax: float, ay: float, bx: float, by: float, cx: float, cy: float, px: float, py: float) -> float:
    """Positive if p lies inside the circle through the left-turning a, b, c; the sign is exact."""
    adx, ady, bdx, bdy, cdx, cdy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    al, bl, cl = adx * adx + ady * ady, bdx * bdx + bdy * bdy, cdx * cdx + cdy * cdy
    bc1, bc2, ca1, ca2, ab1, ab2 = bdx * cdy, cdx * bdy, cdx * ady, adx * cdy, adx * bdy, bdx * ady
    det = al * (bc1 - bc2) + bl * (ca1 - ca2) + cl * (ab1 - ab2)
    size = al * (abs(bc1) + abs(bc2)) + bl * (abs(ca1) + abs(ca2)) + cl * (abs(ab1) + abs(ab2))
    if abs(det) > 12 * EPS * size:
        return det
    ax, ay, bx, by, cx, cy, px, py = map(Fraction, (ax, ay, bx, by, cx, cy, px, py))
    adx, ady, bdx, bdy, cdx, cdy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    d = (adx * adx + ady * ady) * (bdx * cdy - cdx * bdy) + (bdx * bdx + bdy * bdy) * (cdx * ady - adx * cdy) + (cdx * cdx + cdy * cdy) * (adx * bdy - bdx * ady)
    return (d > 0) - (d < 0)


class Triangulation:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x.tolist(), y.tolist()
        self.third: dict[tuple[int, int], int] = {}
        n = len(x)
        rows = max(1, int((n / 4) ** 0.5))
        span = float(y.max() - y.min()) or 1.0 if n else 1.0
        strip = ((y - y.min()) / span * rows).astype(int) if n else y
        order = sorted(range(n), key=lambda i: (strip[i], x[i] if strip[i] % 2 == 0 else -x[i], i))
        seen: set[tuple[float, float]] = set()
        order = [i for i in order if not ((self.x[i], self.y[i]) in seen or seen.add((self.x[i], self.y[i])))]
        self.order = order
        start = self._first(order)
        if start is not None:
            a, b, c = start
            for t in ((a, b, c), (b, a, GHOST), (c, b, GHOST), (a, c, GHOST)):
                self._add(*t)
            self.at = (a, b)
            used = {a, b, c}
            for p in order:
                if p not in used:
                    self._insert(p)

    def _turn(self, a: int, b: int, c: int) -> float:
        x, y = self.x, self.y
        return orient(x[a], y[a], x[b], y[b], x[c], y[c])

    def _first(self, order: list[int]) -> tuple[int, int, int] | None:
        """A left-turning triangle to begin with; None if all points are on a line."""
        for k in range(2, len(order)):
            t = self._turn(order[0], order[1], order[k])
            if t:
                return (order[0], order[1], order[k]) if t > 0 else (order[1], order[0], order[k])
        return None

    def _add(self, u: int, v: int, w: int) -> None:
        t = self.third
        t[u, v], t[v, w], t[w, u] = w, u, v

    def _drop(self, u: int, v: int, w: int) -> None:
        t = self.third
        del t[u, v], t[v, w], t[w, u]

    def _conflict(self, u: int, v: int, w: int, p: int) -> bool:
        """Whether p is inside the triangle's circle; for a ghost's, beyond its hull edge or on it."""
        if GHOST in (u, v, w):
            while w != GHOST:
                u, v, w = v, w, u
            t = self._turn(u, v, p)
            if t:
                return t > 0
            x, y = self.x, self.y
            return (x[p] - x[u]) * (x[p] - x[v]) + (y[p] - y[u]) * (y[p] - y[v]) < 0
        x, y = self.x, self.y
        return in_circle(x[u], y[u], x[v], y[v], x[w], y[w], x[p], y[p]) > 0

    def _locate(self, p: int) -> tuple[int, int, int]:
        u, v = self.at
        w = self.third[u, v]
        while w == GHOST or GHOST in (u, v):  # start inside
            if w != GHOST:
                u, v, w = v, w, u
                continue
            u, v = v, u
            w = self.third[u, v]
        while True:
            for a, b, c in ((u, v, w), (v, w, u), (w, u, v)):
                if self._turn(a, b, p) < 0:
                    u, v, w = b, a, self.third[b, a]
                    break
            else:
                return u, v, w
            if w == GHOST:
                return u, v, w

    def _insert(self, p: int) -> None:
        u, v, w = self._locate(p)
        self._drop(u, v, w)
        stack = [(u, v), (v, w), (w, u)]
        while stack:
            a, b = stack.pop()
            c = self.third.get((b, a))
            if c is None:
                continue
            if self._conflict(b, a, c, p):
                self._drop(b, a, c)
                stack += [(a, c), (c, b)]
            else:
                self._add(p, a, b)
        self.at = self._some_edge(p, u, v, w)

    def _some_edge(self, p: int, *around: int) -> tuple[int, int]:
        for a in around:
            if a != GHOST and (p, a) in self.third:
                return p, a
        return next(e for e in self.third if e[0] == p)

    def triangles(self) -> np.ndarray:
        """(n, 3) corners, each triangle once."""
        return np.array([(u, v, w) for (u, v), w in self.third.items() if 0 <= u < v and u < w], np.int64).reshape(-1, 3)

    def edges(self) -> list[tuple[int, int]]:
        """Each edge once; of points on a line, neighbours along it."""
        if not self.third:
            line = sorted(self.order, key=lambda i: (self.x[i], self.y[i]))
            return [(min(a, b), max(a, b)) for a, b in zip(line, line[1:], strict=False)]
        return [e for e in self.third if 0 <= e[0] < e[1]]

    def hull(self) -> set[int]:
        return {x for e, w in self.third.items() if w == GHOST for x in e} if self.third else set(self.order)
