"""Small graphs for tests and documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph


#: Corners of the square; edges and positions of the nine-vertex example.
SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
LOLLIPOP_AT = [*SQUARE, (2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (4.0, 1.0), (4.0, 0.0)]
LOLLIPOP = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 5)]


def _points(spark: SparkSession, at: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "id long, x double, y double")


def c4(spark: SparkSession) -> Graph:
    """Cycle of four vertices on a unit square."""
    return Graph.from_edges(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "src long, dst long"), _points(spark, SQUARE))


def lollipop(spark: SparkSession) -> Graph:
    """A square and a pentagon-like ring joined by an edge: nine vertices, ten unit edges."""
    return Graph.from_edges(spark.createDataFrame(LOLLIPOP, "src long, dst long"), _points(spark, LOLLIPOP_AT))
