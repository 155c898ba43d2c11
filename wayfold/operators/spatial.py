"""Spatial joins, all by equi-joins on grid buckets and an exact test after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def within_distance(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of a (aid, ax, ay) and b (bid, bx, by) no more than radius apart. Each row of b meets the 3 x 3 buckets around it, so a pair meets once."""
    left = a.withColumns({"gx": bucket(F.col("ax"), radius), "gy": bucket(F.col("ay"), radius)})
    ring = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    right = b.withColumn("o", F.explode(ring)).withColumns({"gx": bucket(F.col("bx"), radius) + F.col("o.dx"), "gy": bucket(F.col("by"), radius) + F.col("o.dy")}).drop("o")
    return left.join(right, ["gx", "gy"]).where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= radius).drop("gx", "gy")


def in_polygons(points: DataFrame, edges: DataFrame, size: float = 10) -> DataFrame:
    """(pid, gid) for each point (pid, px, py) inside a polygon, given as edges (gid, x1, y1, x2, y2) of closed rings: a ray to the right crosses an odd number.

    Edges go to every strip of y that they touch; a point meets the edges of its own strip.
    """
    e = edges.where("y1 <> y2").withColumn("strip", F.explode(F.sequence(bucket(F.least("y1", "y2"), size), bucket(F.greatest("y1", "y2"), size))))
    p = points.withColumn("strip", bucket(F.col("py"), size))
    crossed = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    return p.join(e, "strip").where(crossed).groupBy("pid", "gid").agg(F.count("*").alias("n")).where("n % 2 = 1").select("pid", "gid")


def boxes_to_edges(boxes: DataFrame) -> DataFrame:
    """The four edges of boxes (gid, x0, y0, x1, y1)."""
    corner = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    sides = F.array(*(F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for (a, b), (c, d) in zip(corner, corner[1:] + corner[:1])))
    return boxes.select("gid", F.explode(sides).alias("e")).select("gid", "e.*")


def crossings(segments: DataFrame, size: float = 20) -> DataFrame:
    """(a, b, x, y): where segments of two lines cross inside both; touching ends are no crossing. a < b.

    Segments go to every bucket of their bounding box; a pair is tested in the bucket of the least
    corner that both boxes share, so once.
    """
    cols = ("line_id", "seq", "x1", "y1", "x2", "y2")
    box = segments.select(*cols, F.least("x1", "x2").alias("lx"), F.least("y1", "y2").alias("ly"), F.greatest("x1", "x2").alias("hx"), F.greatest("y1", "y2").alias("hy"))
    laid = box.withColumn("gx", F.explode(F.sequence(bucket(F.col("lx"), size), bucket(F.col("hx"), size)))).withColumn("gy", F.explode(F.sequence(bucket(F.col("ly"), size), bucket(F.col("hy"), size))))
    a = laid.select("gx", "gy", *(F.col(c).alias(f"a_{c}") for c in (*cols, "lx", "ly", "hx", "hy")))
    b = laid.select("gx", "gy", *(F.col(c).alias(f"b_{c}") for c in (*cols, "lx", "ly", "hx", "hy")))
    pair = a.join(b, ["gx", "gy"]).where("a_line_id < b_line_id and a_lx <= b_hx and b_lx <= a_hx and a_ly <= b_hy and b_ly <= a_hy")
    pair = pair.where((F.col("gx") == bucket(F.greatest("a_lx", "b_lx"), size)) & (F.col("gy") == bucket(F.greatest("a_ly", "b_ly"), size)))

    def side(px: str, py: str, qx: str, qy: str, rx: str, ry: str) -> Column:
        c = F.col
        return (c(qx) - c(px)) * (c(ry) - c(py)) - (c(qy) - c(py)) * (c(rx) - c(px))

    d1, d2 = (side("b_x1", "b_y1", "b_x2", "b_y2", f"a_x{k}", f"a_y{k}") for k in (1, 2))
    d3, d4 = (side("a_x1", "a_y1", "a_x2", "a_y2", f"b_x{k}", f"b_y{k}") for k in (1, 2))
    hit = pair.withColumns({"d1": d1, "d2": d2, "d3": d3, "d4": d4}).where("d1 * d2 < 0 and d3 * d4 < 0")
    t = F.col("d1") / (F.col("d1") - F.col("d2"))
    return hit.select(F.col("a_line_id").alias("a"), F.col("b_line_id").alias("b"), (F.col("a_x1") + t * (F.col("a_x2") - F.col("a_x1"))).alias("x"), (F.col("a_y1") + t * (F.col("a_y2") - F.col("a_y1"))).alias("y"))


def distance_to_segments(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(pid, d): the least distance from each point (pid, px, py) to a segment no more than reach away; others give no row."""
    s = segments.withColumn("gx", F.explode(F.sequence(bucket(F.least("x1", "x2") - reach, reach), bucket(F.greatest("x1", "x2") + reach, reach)))).withColumn("gy", F.explode(F.sequence(bucket(F.least("y1", "y2") - reach, reach), bucket(F.greatest("y1", "y2") + reach, reach))))
    p = points.withColumns({"gx": bucket(F.col("px"), reach), "gy": bucket(F.col("py"), reach)})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d = F.hypot(F.col("px") - F.col("x1") - t * dx, F.col("py") - F.col("y1") - t * dy)
    return p.join(s, ["gx", "gy"]).groupBy("pid").agg(F.min(d).alias("d")).where(F.col("d") <= reach)
