"""Isthmus: PySpark-native analytics for graphs and geometric networks."""

__version__ = "0.1.0"
