"""Separator studies: sizes of graphs of a family and of their separators, for scaling-law fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.separator import inertial_separator, separate_recursively
from . import generate


def _thinned_lattice(size: int, degree: float, rng: np.random.Generator) -> tuple[list[list[int]], np.ndarray]:
    """Adjacency lists and positions of the largest component of a square lattice with random edges kept down to the average degree."""
    k = math.isqrt(size)
    at = np.arange(k * k)
    e = np.concatenate([np.c_[at, at + 1][at % k < k - 1], np.c_[at, at + k][at < k * (k - 1)]])
    e = e[rng.permutation(len(e))[: int(degree * k * k / 2)]]
    near: list[list[int]] = [[] for _ in range(k * k)]
    for a, b in e.tolist():
        near[a].append(b)
        near[b].append(a)
    left, best = set(range(k * k)), []
    while left:
        part = [left.pop()]
        for v in part:
            for w in near[v]:
                if w in left:
                    left.discard(w)
                    part.append(w)
        best = max(best, part, key=len)
    best.sort()
    place = {v: i for i, v in enumerate(best)}
    return [[place[w] for w in near[v]] for v in best], np.array([(v // k, v % k) for v in best], float)


def grid_separators(spark: SparkSession, step: int, stop: int, samples: int, degree: float = 2.5, seed: int = 0) -> DataFrame:
    """(size, sample, n, s) for lattices of about step, 2 step, .. vertices below stop, thinned to an average degree: vertices of the largest component and of its separator. One task a sample."""
    runs = spark.range(step, stop, step).select(F.col("id").alias("size")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, sample in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                adj, xy = _thinned_lattice(size, degree, np.random.default_rng([seed, size, sample]))
                yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64()), "sample": pa.array([sample], pa.int32()), "n": pa.array([len(adj)], pa.int64()), "s": pa.array([len(inertial_separator(adj, xy))], pa.int64())})

    return runs.repartition("size", "sample").mapInArrow(run, "size long, sample int, n long, s long")


def nested_grid_separators(spark: SparkSession, shapes: list[tuple[int, int]] = ((3, 10), (4, 6), (5, 5), (6, 4), (7, 4)), least: int = 200) -> DataFrame:
    """(levels, width, n, s) of nested grids, separated along the first parts of more than `least` vertices."""
    out = None
    for levels, width in shapes:
        rows = separate_recursively(generate.nested_grid(spark, width, levels), least, follow="first").select(F.lit(levels).cast("long").alias("levels"), F.lit(width).cast("long").alias("width"), "n", "s")
        out = rows if out is None else out.union(rows)
    return out
