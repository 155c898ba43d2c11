"""An addition of our own: cell aggregates of points that still arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.raster import to_cells


def running_cells(points: DataFrame, res: float) -> DataFrame:
    """(cx, cy, n, zmin, zmax) of a stream of points, for update or complete output; state is one row a cell."""
    return to_cells(points, res).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))
