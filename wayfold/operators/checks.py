"""What is asked of tables and parameters before a job starts, and figures that describe a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.params import Parameters


def need_columns(df: DataFrame, what: str, *columns: str) -> None:
    """Raises ValueError naming the columns that df lacks; nothing is read."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{what} must have {', '.join(columns)}; {', '.join(lacking)} not found")


def need_resolution(res: float, most: float, what: str) -> None:
    """Raises ValueError for cells wider than `most`."""
    if round(res, 2) > most:
        raise ValueError(f"{what} must have cells of {most:g} or less, not {res:g}")


def need_tiles(size: float, res: float) -> None:
    """Raises ValueError for tiles of less than two cells; 0 stands for no tiles."""
    if 0 < size < 2 * res:
        raise ValueError(f"tiles of {size:g} are smaller than two cells of {res:g}")


def need_parameters(p: Parameters) -> None:
    """Raises ValueError where a road could be wider than the buffer that it is looked for in, or a share is none."""
    e = p.extraction
    if e.road_max_width > e.road_buffer:
        raise ValueError("road_max_width must be smaller than road_buffer")
    if min(e.section_length, e.profile_resolution, e.road_max_len) <= 0:
        raise ValueError("section_length, profile_resolution and road_max_len must be over 0")
    if not 0 <= p.confidence <= 1:
        raise ValueError("confidence must lie between 0 and 1")


def faulty_lines(v: DataFrame) -> DataFrame:
    """(line_id, fault): lines of one vertex, with a null or non-finite place, or with a place number twice; one grouped pass."""
    bad = F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    g = v.groupBy("line_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_distinct("seq").alias("places"))
    fault = F.when(F.col("bad") > 0, "place unknown").when(F.col("n") < 2, "one vertex").when(F.col("places") < F.col("n"), "place number twice")
    return g.select("line_id", fault.alias("fault")).where("fault is not null")


def point_density(points: DataFrame) -> DataFrame:
    """(n, area, density): points by the area of the box around them; one row, density null without an area."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    g = points.agg(F.count("*").alias("n"), F.coalesce(area, F.lit(0.0)).alias("area"))
    return g.withColumn("density", F.try_divide("n", "area"))


def flightline_count(points: DataFrame) -> DataFrame:
    """One row: the number of different flightlines."""
    return points.agg(F.count_distinct("psid").alias("n"))


def share_true(what: Column) -> Column:
    """An aggregate: the share of rows that `what` holds for; 0 for none at all, null where it is unknown for some."""
    known = F.when(F.count(what) == F.count("*"), F.avg(what.cast("double")))
    return F.when(F.count("*") == 0, F.lit(0.0)).otherwise(known)
