"""Spark-native analytics for point clouds, raster grids, line networks and training text."""

__version__ = "0.1.0"
