"""Column functions for points, segments and polygons, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def square(c: Column) -> Column:
    """c * c, bit for bit the same in any engine."""
    return c * c


def dist2(ax: Column | str, ay: Column | str, bx: Column | str, by: Column | str) -> Column:
    """Squared Euclidean distance."""
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return dx * dx + dy * dy


def dist(ax: Column | str, ay: Column | str, bx: Column | str, by: Column | str) -> Column:
    return F.sqrt(dist2(ax, ay, bx, by))


def cell(c: Column | str, size: float) -> Column:
    """Grid cell of a coordinate."""
    return F.floor(col(c) / F.lit(float(size))).cast("long")


def quantise(c: Column | str, scale: float = 1e12) -> Column:
    """Whole-number key of a coordinate, sign kept; |c| * scale must fit 63 bits."""
    return F.round(col(c) * F.lit(scale)).cast("long")


def dequantise(c: Column | str, scale: float = 1e12) -> Column:
    return col(c).cast("double") / F.lit(scale)


def _ring(xs: Column, ys: Column) -> Column:
    """Indices of a closed ring's corners; corner i is joined to corner (i + 1) mod n."""
    return F.sequence(F.lit(0), F.size(xs) - 1)


def _next(a: Column, i: Column) -> Column:
    return F.get(a, F.when(i + 1 < F.size(a), i + 1).otherwise(F.lit(0)))


def in_polygon(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    """Whether a point lies in the polygon whose corners are given as two arrays: parity of crossings to the right."""

    def crosses(i: Column) -> Column:
        x1, y1, x2, y2 = F.get(xs, i), F.get(ys, i), _next(xs, i), _next(ys, i)
        return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)

    return F.size(F.filter(_ring(xs, ys), crosses)) % 2 == 1


def polygon_area2(xs: Column, ys: Column) -> Column:
    """Twice the signed area."""
    return F.aggregate(_ring(xs, ys), F.lit(0.0), lambda acc, i: acc + F.get(xs, i) * _next(ys, i) - _next(xs, i) * F.get(ys, i))


def polygon_area(xs: Column, ys: Column) -> Column:
    return F.abs(polygon_area2(xs, ys)) / 2


def polygon_centroid(xs: Column, ys: Column) -> tuple[Column, Column]:
    def part(a: Column) -> Column:
        return F.aggregate(_ring(xs, ys), F.lit(0.0), lambda acc, i: acc + (F.get(a, i) + _next(a, i)) * (F.get(xs, i) * _next(ys, i) - _next(xs, i) * F.get(ys, i)))

    twice = polygon_area2(xs, ys)
    return part(xs) / (3 * twice), part(ys) / (3 * twice)


def polygon_box(xs: Column, ys: Column) -> tuple[Column, Column, Column, Column]:
    """Least x and y, largest x and y."""
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def uniform(seed: int, *keys: Column | str, draw: int = 0) -> Column:
    """A number in [0, 1) that depends on the seed, the keys and the draw only, whatever the partitioning."""
    h = F.xxhash64(F.lit(seed), F.lit(draw), *(col(k) for k in keys))
    return h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def lcg_uniform(seed: int, key: Column | str) -> Column:
    """A whole number below 2**32 by a multiplicative hash, which any SQL engine gives alike."""
    return (col(key) * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)
