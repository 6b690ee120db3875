"""Boltzmann sampling by tables of branching values: the table's reader, choices by it, and bicoloured binary trees.

A table file has cases, each begun by a line 'case<size>' and followed by its vectors, one a line, blank lines between.
Values of a vector are cumulative: a uniform number u chooses the number of values that aren't above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .formats import _numbered_lines

#: Sections of a case in their order, and how many vectors each has.
SECTIONS = (("binary trees", 9), ("3-connected networks", 4), ("networks", 20), ("2-connected graphs", 4), ("connected graphs", 4), ("planar graphs", 3))


def read_coefficients(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(section, vector, k, value) of a case: vectors are numbered from 0 within their section, values from 0 within their vector. A word that is no number is an error."""
    lines = _numbered_lines(spark, path).select("n", F.trim("value").alias("value"))
    cases = lines.where("value LIKE 'case%'")
    start = cases.where(F.col("value") == f"case{size}").agg(F.min("n").alias("first"))
    bounds = cases.crossJoin(F.broadcast(start)).agg(F.min("first").alias("first"), F.min(F.when(F.col("n") > F.col("first"), F.col("n"))).alias("last"))
    rows = lines.crossJoin(F.broadcast(bounds)).where("n > first AND (last IS NULL OR n < last) AND value <> '' AND value NOT LIKE '#%'")
    places = [(name, i, sum(m for _, m in SECTIONS[:s]) + i) for s, (name, many) in enumerate(SECTIONS) for i in range(many)]
    names = spark.createDataFrame(places, "section string, vector int, place long")
    # a case has few lines, so one window holds them
    vectors = rows.withColumn("place", (F.row_number().over(Window.orderBy("n")) - 1).cast("long")).join(F.broadcast(names), "place")
    return vectors.select("section", "vector", F.posexplode(F.split("value", r"\s+")).alias("k", "value")).select("section", "vector", "k", F.col("value").cast("double").alias("value"))


def choose(cumulative: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Index chosen by each uniform number: how many of the cumulative values aren't above it."""
    return np.searchsorted(cumulative, u, side="right")


def bicoloured_tree(black_first: float, leaf_for_black: float, leaf_for_white: float, rng: np.random.Generator, root: str = "either", most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """(colour, parent) of the inner nodes of a random binary tree whose neighbouring nodes differ in colour; 0 is black, the root's parent is -1.

    Each of a node's two places holds a leaf, with the chance of a leaf where a black (white) node could be, or else a
    node of the other colour. The root is black, white, or either, black with black_first. With most, trees with more
    inner nodes are rejected (None), as soon as that is known.
    """
    first = {"black": 0, "white": 1}.get(root)
    colours = [int(rng.random() >= black_first) if first is None else first]
    parents, at = [-1], 0
    stop = (leaf_for_black, leaf_for_white)
    while at < len(colours):
        if most is not None and len(colours) > most:
            return None
        other = 1 - colours[at]
        for u in rng.random(2).tolist():
            if u >= stop[other]:
                colours.append(other)
                parents.append(at)
        at += 1
    return np.array(colours), np.array(parents)


def sampled_trees(runs: DataFrame, black_first: float, leaf_for_black: float, leaf_for_white: float, root: str = "either", most: int | None = None) -> DataFrame:
    """(run_id, nodes, black, white, leaves, mixed) for rows (run_id, seed): counters of one tree each, all null if it was rejected; mixed tells whether all neighbours differ in colour."""
    schema = "run_id long, nodes long, black long, white long, leaves long, mixed boolean"
    out = pa.schema([(n, pa.bool_() if n == "mixed" else pa.int64()) for n in ("run_id", "nodes", "black", "white", "leaves", "mixed")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run_id, seed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = bicoloured_tree(black_first, leaf_for_black, leaf_for_white, np.random.default_rng([seed, run_id]), root, most)
                if tree is None:
                    rows.append((run_id, None, None, None, None, None))
                    continue
                colour, parent = tree
                n, white = len(colour), int(colour.sum())
                rows.append((run_id, n, n - white, white, 2 * n - (n - 1), bool((colour[1:] != colour[parent[1:]]).all())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return runs.select("run_id", "seed").mapInArrow(run, schema)
