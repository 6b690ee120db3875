"""Sequential kernels against brute force, without Spark."""

import numpy as np
import pytest

from isthmus.operators.separator import part_diameter
from isthmus.sources import boltzmann, kernels


def layers(adj, start):
    seen, front, hops = {start}, [start], 0
    while True:
        front = [w for w in {w for v in front for w in adj[v]} if w not in seen]
        if not front:
            return len(seen), hops
        seen.update(front)
        hops += 1


@pytest.mark.parametrize("seed", range(40))
def test_part_diameter(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    adj = [[] for _ in range(n)]
    for v in range(1, n):  # a random tree and some more edges
        for w in {int(rng.integers(v)), int(rng.integers(n))} - {v}:
            if w not in adj[v]:
                adj[v].append(w)
                adj[w].append(v)
    assert part_diameter(adj) == max(layers(adj, v)[1] for v in range(n))


def inside(ring, points, p):
    """Crossing parity, for points that are no corners."""
    x, y = points[p]
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        (x1, y1), (x2, y2) = points[a], points[b]
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(10))
def test_concave_hull_holds_all_points(seed):
    rng = np.random.default_rng(seed)
    angle, r = rng.uniform(0, 4.5, 150), rng.uniform(0.7, 1, 150)  # most of a ring, so the convex hull is much larger
    points = np.c_[r * np.cos(angle), r * np.sin(angle)]
    ids = list(range(150))
    ring, convex = kernels.concave_hull(points, ids), kernels._hull(points, ids)
    assert set(convex) <= set(ring) and len(set(ring)) == len(ring)
    assert all(inside(ring, points, p) for p in set(ids) - set(ring))
    size = lambda h: kernels.area([tuple(points[i]) for i in h])
    assert size(ring) < 0.95 * size(convex)
    assert kernels.concave_hull(points, ids, 1e9) == convex


def test_choice_counts_the_values_not_above():
    u = np.array([0.0, 0.1, 0.2, 0.5, 0.99])
    assert boltzmann.choose(np.array([0.1, 0.5]), u).tolist() == [0, 1, 1, 2, 2]


def test_trees_alternate_and_respect_the_cap():
    for seed in range(300):
        tree = boltzmann.bicoloured_tree(0.4, 0.6, 0.6, np.random.default_rng(seed))
        colour, parent = tree
        assert parent[0] == -1 and (colour[1:] != colour[parent[1:]]).all() and np.bincount(parent[1:], minlength=1).max(initial=0) <= 2
        capped = boltzmann.bicoloured_tree(0.4, 0.6, 0.6, np.random.default_rng(seed), most=4)
        assert (capped is None) == (len(colour) > 4)
    roots = [boltzmann.bicoloured_tree(0.4, 1.0, 1.0, np.random.default_rng(s))[0][0] for s in range(2000)]
    assert abs(np.mean(roots) - 0.6) < 0.06
