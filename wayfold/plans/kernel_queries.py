"""The flagship grid, and queries whose steps are kernels, which SQL cannot say; tests/ hold those against plain Python."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wayfold.operators import conductivity as C
from wayfold.operators.network import node_members
from wayfold.operators.paths import least_cost_paths
from wayfold.operators.raster import rasterize
from wayfold.operators.roads import measure_roads as measure
from wayfold.operators.smoothing import simplified, smoothed
from wayfold.operators.snapping import snap_advanced as snap
from wayfold.operators.spatial import boxes_to_edges
from wayfold.params import DEFAULTS

from . import views as V
from .raster_queries import FOCAL, SLOPE, sql_sobel
from .registry import query, sql_linear, sql_steps, sql_window
from .views import with_views

BANDS = {
    "z": "SELECT cx, cy, dtm AS v FROM dtm",
    "sl": sql_window("z", 1, SLOPE),
    "s5": sql_window("z", 2, FOCAL.format(n=25).replace("round(avg(v), 6)", "avg(v)")),
    "rs": "SELECT cx, cy, z.v - s5.v AS v FROM z JOIN s5 USING (cx, cy)",
    "ro": sql_window("rs", 1, "CASE WHEN count(v) = 9 THEN max(v) - min(v) END"),
    "so": sql_window("sl", 1, sql_sobel(3, 9)),
    "u": "SELECT psid, count(*) AS n, median(intensity) AS med FROM np GROUP BY psid",
    "fa": "SELECT psid, CASE WHEN med / nullif(ref, 0) = 0 THEN 1 ELSE med / nullif(ref, 0) END AS factor FROM u, (SELECT med AS ref FROM u ORDER BY n DESC, psid LIMIT 1)",
    "ci": "SELECT np.* REPLACE (CAST(trunc(intensity / factor) AS INT) AS intensity) FROM np JOIN fa USING (psid)",
    "cc": "SELECT * REPLACE (least(intensity, (SELECT 2 * CAST(trunc(quantile_cont(intensity, 0.98)) AS INT) FROM ci)) AS intensity) FROM ci",
    "ce": "SELECT cx, cy, max(zn) AS chm, count(*) FILTER (WHERE zn > 0.5 AND zn < 3) AS low, max(intensity) - min(intensity) AS irange, count(*) FILTER (WHERE cls = 2) AS d0 FROM cc GROUP BY cx, cy",
    "de": sql_window("ce", 1, "avg(CASE WHEN dx = 0 AND dy = 0 THEN 2 * v ELSE v END)", "d0"),
    "al": "SELECT z.cx, z.cy, sl.v AS slope, round(ro.v, 9) AS rough, so.v AS sobel, chm, low, irange, round(de.v, 9) AS density FROM z LEFT JOIN sl USING (cx, cy) LEFT JOIN ro USING (cx, cy) LEFT JOIN so USING (cx, cy) LEFT JOIN ce USING (cx, cy) LEFT JOIN de USING (cx, cy)",
    "th": "SELECT quantile_cont(irange, 0.1) AS i0, quantile_cont(irange, 0.5) AS i1, quantile_cont(density, 0.25) FILTER (WHERE density > 0) AS d0, quantile_cont(density, 0.95) FILTER (WHERE density > 0) AS d1 FROM al",
    "si": "SELECT cx, cy, "
    + f"{sql_linear('slope', 5, 20, False)} * {sql_steps('coalesce(low, 0)', (2,), False)} * {sql_steps('sobel', (40,), False)} * (2 * {sql_linear('density', 'd0', 'd1')} + {sql_linear('chm', 0.1, 0.2, False)} + {sql_linear('rough', 0.05, 0.1, False)} + {sql_linear('irange', 'i0', 'i1', False)}) / 5 AS s FROM al, th",
}


@query(with_views("SELECT CAST(floor(cx / 2) AS INT) AS cx, CAST(floor(cy / 2) AS INT) AS cy, round(avg(CASE WHEN s < 0.1 THEN 0.1 ELSE s END), 6) AS sigma FROM si GROUP BY 1, 2", "np", **BANDS))
def conductivity_grid(spark, sf):
    return C.conductivity_v1(V.points(spark, sf)).withColumn("sigma", F.round("sigma", 6))


def wet(spark, sf):
    return boxes_to_edges(V.water(spark, sf))


@query()
def conductivity_grid_v2(spark, sf):
    return C.conductivity_v2(V.points(spark, sf), water=wet(spark, sf)).withColumn("sigma", F.round("sigma", 6))


@query()
def conductivity_raw_bands_v2(spark, sf):
    return C.conductivity_v2(V.points(spark, sf), raw=True)


@query()
def edge_enhance(spark, sf):
    return C.edge_enhanced(V.cells(spark, sf).withColumn("v", F.col("v") / 5), tile=64)


@query()
def simplify_lines(spark, sf):
    return simplified(V.vertices(spark, sf), 3)


@query()
def smooth_lines(spark, sf):
    return smoothed(V.vertices(spark, sf))


def dense(spark, sf):
    """The points at half the scale, so that few cells have none."""
    return V.points(spark, sf).withColumns({"x": F.col("x") / 2, "y": F.col("y") / 2})


def road_lines(spark, sf):
    """A line through the dense points for each nation."""
    k = F.col("n_nationkey").cast("long")
    n = V.table(spark, sf, "nation").select(k.alias("line_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("seq"))
    return n.select("line_id", "seq", (F.col("seq") * 12.0 + 3).cast("double").alias("x"), (F.col("line_id") * 1.5 + (F.col("seq") * 5 + F.col("line_id")) % 7 + 3).cast("double").alias("y"))


SMALL = replace(DEFAULTS, extraction=replace(DEFAULTS.extraction, road_buffer=40))


def sigma(spark, sf):
    """Over a terrain of the least height of all points, as ground points alone leave too many gaps."""
    p = dense(spark, sf)
    return C.conductivity_v1(p, rasterize(p, 1, F.min("z").alias("dtm")))


@query()
def least_cost_path(spark, sf):
    return least_cost_paths(sigma(spark, sf), road_lines(spark, sf), SMALL)


@query()
def least_cost_path_over_water(spark, sf):
    small = V.water(spark, sf).select("gid", *((F.col(c) / 2).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return least_cost_paths(sigma(spark, sf), road_lines(spark, sf), SMALL, water=boxes_to_edges(small))


@query()
def measure_roads(spark, sf):
    return measure(dense(spark, sf), road_lines(spark, sf), SMALL, sigma(spark, sf))[0]


@query()
def relocated_lines(spark, sf):
    return measure(dense(spark, sf), road_lines(spark, sf), SMALL, sigma(spark, sf), keep_class=4)[1]


@query()
def measure_in_place(spark, sf):
    return measure(dense(spark, sf), road_lines(spark, sf), replace(SMALL, confidence=1))[0]


def members(spark, sf):
    m = node_members(V.vertices(spark, sf), V.roads(spark, sf), 40, 40)
    place = F.split("node", "_")
    return m.withColumns({"x": F.get(place, 0).cast("double") * 40, "y": F.get(place, 1).cast("double") * 40, "updatable": F.col("line_id") % 3 != 0, "class": F.coalesce("class", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})


@query()
def snap_advanced(spark, sf):
    return snap(V.vertices_cor(spark, sf), members(spark, sf), 30)[0]


@query()
def snap_advanced_warnings(spark, sf):
    return snap(V.vertices_cor(spark, sf), members(spark, sf), 30)[1]
