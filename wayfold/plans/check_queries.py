"""Queries that check tables and describe scans, and those on slices' terrain and drivable bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import checks as K
from wayfold.operators import lines as L
from wayfold.operators import points as P
from wayfold.operators import profiles as Q
from wayfold.operators import raster as R

from . import views as V
from .profile_queries import EDGES, fixed_edges
from .registry import query
from .views import with_views


@query(with_views("SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area, round(count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)), 0), 6) AS density FROM points", "points"))
def point_density(spark, sf):
    return K.point_density(V.points(spark, sf)).withColumn("density", F.round("density", 6))


@query(with_views("SELECT count(DISTINCT psid) AS n FROM points", "points"))
def flightline_count(spark, sf):
    return K.flightline_count(V.points(spark, sf))


@query(with_views("SELECT psid, round(avg(CASE WHEN cls = 2 THEN 1.0 ELSE 0.0 END), 6) AS share FROM points GROUP BY psid", "points"))
def share_of_ground(spark, sf):
    return V.points(spark, sf).groupBy("psid").agg(F.round(K.share_true(F.col("cls") == 2), 6).alias("share"))


@query(
    with_views(
        "SELECT line_id, CASE WHEN bad > 0 THEN 'place unknown' WHEN n < 2 THEN 'one vertex' WHEN places < n THEN 'place number twice' END AS fault FROM (SELECT line_id, count(*) AS n, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS bad, count(DISTINCT seq) AS places FROM faulty GROUP BY line_id) WHERE bad > 0 OR n < 2 OR places < n",
        "vertices",
        faulty="SELECT line_id, CASE WHEN line_id % 7 = 1 THEN 1 ELSE seq END AS seq, CASE WHEN line_id % 11 = 3 AND seq = 2 THEN NULL ELSE x END AS x, y FROM vertices WHERE line_id % 13 <> 5 OR seq = 1",
    )
)
def faulty_lines(spark, sf):
    v = V.vertices(spark, sf).where("line_id % 13 <> 5 or seq = 1")
    return K.faulty_lines(v.withColumns({"seq": F.when(F.col("line_id") % 7 == 1, F.lit(1)).otherwise(F.col("seq")), "x": F.when((F.col("line_id") % 11 == 3) & (F.col("seq") == 2), None).otherwise(F.col("x"))}))


@query(with_views("SELECT line_id, seq, round(m / nullif(length, 0) * (length + line_id % 10), 6) AS place FROM mv JOIN lens USING (line_id)", "mv", "lens"))
def rescaled_position(spark, sf):
    v = V.vertices(spark, sf)
    path = L.lengths(v).withColumn("length", F.col("length") + F.col("line_id") % 10)
    return L.rescaled(v, path).select("line_id", "seq", F.round("place", 6).alias("place"))


BOX = (500.0, 10.0, 4000.0, 505.0)


def sql_span(c: str, lo: float, hi: float) -> str:
    low, high = f"({lo} - {c}1) / nullif({c}2 - {c}1, 0)", f"({hi} - {c}1) / nullif({c}2 - {c}1, 0)"
    return f"coalesce(least({low}, {high}), 0) AS {c}a, coalesce(greatest({low}, {high}), 1) AS {c}b"


@query(
    with_views(
        "SELECT line_id, seq, " + ", ".join(f"round({c}1 + {t} * ({c}2 - {c}1), 6) AS {c}{k}" for k, t in ((1, "ta"), (2, "tb")) for c in "xy") + " FROM t WHERE ta < tb",
        "segs",
        p=f"SELECT *, {sql_span('x', BOX[0], BOX[2])}, {sql_span('y', BOX[1], BOX[3])} FROM segs WHERE greatest(x1, x2) >= {BOX[0]} AND least(x1, x2) <= {BOX[2]} AND greatest(y1, y2) >= {BOX[1]} AND least(y1, y2) <= {BOX[3]}",
        t="SELECT *, greatest(0, xa, ya) AS ta, least(1, xb, yb) AS tb FROM p",
    )
)
def crop_lines(spark, sf):
    c = L.cropped(V.vertices(spark, sf), *BOX)
    return c.select("line_id", "seq", *(F.round(k, 6).alias(k) for k in ("x1", "y1", "x2", "y2")))


@query(
    with_views(
        """SELECT line_id, k, round(x1 + t * (x2 - x1), 6) AS x, round(y1 + t * (y2 - y1), 6) AS y FROM (
 SELECT s.*, k, coalesce((m - m1) / nullif(m2 - m1, 0), 0) AS t, row_number() OVER (PARTITION BY line_id, k ORDER BY seq) AS r FROM a JOIN segs s USING (line_id) WHERE m >= m1 AND m <= m2) WHERE r = 1""",
        "segs",
        "lens",
        a="SELECT line_id, k, length - length * k / 4.7 AS m FROM lens, (SELECT unnest([0, 1, 2, 3]) AS k)",
    )
)
def locate_from_end(spark, sf):
    v = V.vertices(spark, sf)
    at = L.lengths(v).select("line_id", F.explode(F.array(*map(F.lit, range(4)))).alias("k"), "length").select("line_id", "k", (F.col("length") * F.col("k") / 4.7).alias("m"))
    return L.locate(v, at, from_end=True, strict=True).select("line_id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def slice_cells(spark, sf):
    """The least z of each slice's cells of 2 across."""
    p = V.slice_points(spark, sf).select("slice_id", F.floor("x").cast("int").alias("cx"), F.floor(F.col("pos") / 2).cast("int").alias("cy"), "z")
    return p.groupBy("slice_id", "cx", "cy").agg(F.min("z").alias("v"))


def offsets(spark, sf):
    return V.slice_points(spark, sf).select("slice_id").distinct().select("slice_id", (F.col("slice_id") % 3 * 1.5).cast("double").alias("xc"))


FLAT = {
    "sc": "SELECT slice_id, CAST(floor(x) AS INT) AS cx, CAST(floor(pos / 2) AS INT) AS cy, min(z) AS v FROM sp GROUP BY 1, 2, 3",
    "xo": "SELECT DISTINCT slice_id, CAST(slice_id % 3 * 1.5 AS DOUBLE) AS xc FROM sp",
    "ro": "SELECT sc.slice_id, cx, v FROM sc JOIN xo USING (slice_id) WHERE cy = CAST(floor(xc / 2) AS INT)",
    "fl": "SELECT a.slice_id, a.cx, a.cy, ro.v FROM sc a LEFT JOIN ro USING (slice_id, cx)",
}


@query(with_views("SELECT slice_id, cx, cy, v FROM fl", "sp", **FLAT))
def flat_road_terrain(spark, sf):
    return R.flat_across(slice_cells(spark, sf), offsets(spark, sf), 2).select("slice_id", "cx", "cy", "v")


@query(with_views("SELECT slice_id, v FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY cy DESC, cx) AS r FROM fl) WHERE r = 1", "sp", **FLAT))
def road_elevation(spark, sf):
    return R.first_cell(R.flat_across(slice_cells(spark, sf), offsets(spark, sf), 2))


@query(
    with_views(
        "SELECT slice_id, xr, round(coalesce(avg(z) FILTER (WHERE d = 0), sum(z / (d * d)) FILTER (WHERE d > 0) / sum(1 / (d * d)) FILTER (WHERE d > 0)), 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, xr ORDER BY d, z) AS r FROM n) WHERE r <= 10 GROUP BY slice_id, xr",
        "sp",
        pl="SELECT DISTINCT slice_id, xr FROM sp",
        n="SELECT slice_id, pl.xr, z, sqrt((x - slice_id * 10 - 5.0) * (x - slice_id * 10 - 5.0) + (pos - pl.xr) * (pos - pl.xr)) AS d FROM sp JOIN pl USING (slice_id) WHERE cls IN (2, 9)",
    )
)
def slice_terrain_idw(spark, sf):
    p = V.slice_points(spark, sf).withColumn("along", F.col("x") - F.col("slice_id") * 10 - 5.0)
    at = p.select("slice_id", F.col("xr").alias("tid"), F.lit(0.0).alias("tx"), F.col("xr").alias("ty")).distinct()
    return Q.inverse_distance(p, at).select("slice_id", F.col("tid").alias("xr"), F.round("z", 6).alias("z"))


LOW = "count(*) FILTER (WHERE ok AND z < 5)"


@query(
    with_views(
        f"""SELECT slice_id, CASE WHEN n IS NULL THEN 0 ELSE p05 END AS p05, CASE WHEN n IS NULL THEN 100 ELSE p2 END AS p2, pground FROM e LEFT JOIN (
 SELECT slice_id, count(*) AS n, round(100 * count(*) FILTER (WHERE ok AND z > 0.5 AND z < 5) / nullif({LOW}, 0), 1) AS p05, round(100 * count(*) FILTER (WHERE ok AND z > 2 AND z < 5) / nullif({LOW}, 0), 1) AS p2,
 round(100 * count(*) FILTER (WHERE ok AND cls = 2) / nullif(count(*) FILTER (WHERE ok), 0), 1) AS pground
 FROM (SELECT *, pos > -2 AND pos < slice_id % 4 AS ok FROM sp JOIN e USING (slice_id) WHERE pos > "left" AND pos < "right") GROUP BY slice_id) USING (slice_id)""",
        "sp",
        e=EDGES,
    )
)
def drivable_percentages(spark, sf):
    e = fixed_edges(spark, sf)
    drive = e.select("slice_id", F.lit(-2.0).alias("left"), (F.col("slice_id") % 4).cast("double").alias("right"))
    return Q.drivable_percentages(V.slice_points(spark, sf), e, drive)


@query(with_views("SELECT psid, min(cap) AS cap, max(least(intensity, cap)) AS top FROM points, (SELECT CAST(trunc(quantile_cont(intensity, 0.98)) AS INT) AS cap FROM points) GROUP BY psid", "points"))
def outlier_cap_once(spark, sf):
    return P.cap_outliers(V.points(spark, sf), times=1).groupBy("psid").agg(F.min("cap").alias("cap"), F.max("intensity").alias("top"))


@query(with_views("SELECT psid, 0 AS lo, 0 AS hi FROM points GROUP BY psid", "points"))
def scan_without_intensity(spark, sf):
    return P.with_intensity(V.points(spark, sf).drop("intensity")).groupBy("psid").agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))
