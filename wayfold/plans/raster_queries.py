"""Queries over points and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import scalar as S
from wayfold.operators import points as P
from wayfold.operators import raster as R
from wayfold.operators.spatial import boxes_to_edges, in_polygons

from . import views as V
from .registry import at, query, sql_linear, sql_steps, sql_window
from .views import with_views

CENTRE = "(CAST(cx AS DOUBLE) + 0.5)", "(CAST(cy AS DOUBLE) + 0.5)"
SQL_CAP = "SELECT psid, cls, cx, cy, zn, least(intensity, (SELECT 2 * CAST(trunc(quantile_cont(intensity, 0.98)) AS INT) FROM np)) AS intensity FROM np"


def normal(spark, sf):
    p = V.points(spark, sf)
    return P.normalize_height(p, P.ground_model(p))


for _name, _spark, _sql in (("max", lambda: F.max("z"), "max(z)"), ("min", lambda: F.min("z"), "min(z)"), ("count", lambda: F.count("*"), "count(*)"), ("density", lambda: F.count("*") / 25, "count(*) / 25")):

    @query(with_views(f"SELECT CAST(floor(x / 5) AS INT) AS cx, CAST(floor(y / 5) AS INT) AS cy, {_sql} AS v FROM points GROUP BY ALL", "points"), f"raster_{_name}")
    def _raster(spark, sf, agg=_spark):
        return R.rasterize(V.points(spark, sf), 5, agg().alias("v"))


@query(with_views("SELECT cx, cy, max(zn) AS chm FROM np GROUP BY cx, cy", "np"))
def canopy_height(spark, sf):
    return normal(spark, sf).groupBy("cx", "cy").agg(F.max("zn").alias("chm"))


@query(with_views("SELECT psid, count(*) AS n, round(min(zn), 6) AS lo, round(avg(zn), 6) AS mean FROM np GROUP BY psid", "np"))
def normalized_heights(spark, sf):
    return normal(spark, sf).groupBy("psid").agg(F.count("*").alias("n"), F.round(F.min("zn"), 6).alias("lo"), F.round(F.avg("zn"), 6).alias("mean"))


@query(with_views("SELECT cx, cy, max(intensity) - min(intensity) AS irange FROM c GROUP BY cx, cy", "np", c=SQL_CAP))
def intensity_range(spark, sf):
    return P.cap_outliers(normal(spark, sf)).groupBy("cx", "cy").agg((F.max("intensity") - F.min("intensity")).alias("irange"))


SQL_U = "SELECT psid, count(*) AS n, min(intensity) AS imin, median(intensity) AS med, stddev_samp(intensity) AS sd FROM points GROUP BY psid"


@query(with_views("SELECT psid, n, imin, med, round(sd, 6) AS sd FROM u", "points", u=SQL_U))
def flightline_summary(spark, sf):
    return P.flightline_summary(V.points(spark, sf)).withColumn("sd", F.round("sd", 6))


@query(
    with_views(
        "SELECT psid, any_value(n) AS n, any_value(round(factor, 6)) AS factor, CAST(sum(CAST(trunc(intensity / factor) AS BIGINT)) AS BIGINT) AS total FROM points JOIN f USING (psid) GROUP BY psid",
        "points",
        u=SQL_U,
        f="SELECT psid, n, CASE WHEN med / nullif(ref, 0) = 0 THEN 1 ELSE med / nullif(ref, 0) END AS factor FROM u, (SELECT med AS ref FROM u ORDER BY n DESC, psid LIMIT 1)",
    )
)
def intensity_flightline_norm(spark, sf):
    p = V.points(spark, sf)
    f = P.flightline_factors(p).select("psid", "n", F.round("factor", 6).alias("factor"))
    return P.correct_intensity(p).groupBy("psid").agg(F.sum(F.col("intensity").cast("long")).alias("total")).join(F.broadcast(f), "psid")


@query(with_views("SELECT psid, round(min(zs), 6) AS lo, round(max(zs), 6) AS hi FROM (SELECT psid, coalesce((intensity - avg(intensity) OVER w) / nullif(stddev_samp(intensity) OVER w, 0), 0) AS zs FROM points WINDOW w AS (PARTITION BY psid)) GROUP BY psid", "points"))
def intensity_zscore(spark, sf):
    return P.z_score(V.points(spark, sf)).groupBy("psid").agg(F.round(F.min("zs"), 6).alias("lo"), F.round(F.max("zs"), 6).alias("hi"))


@query(with_views("SELECT psid, any_value(cap) AS cap, count(*) FILTER (WHERE intensity > cap) AS n_capped FROM points, (SELECT CAST(trunc(quantile_cont(intensity, 0.98)) AS INT) AS cap FROM points) GROUP BY psid", "points"))
def outlier_cap_q98(spark, sf):
    return P.cap_outliers(V.points(spark, sf).withColumn("raw", F.col("intensity")), times=1).groupBy("psid").agg(F.first("cap").alias("cap"), F.count_if(F.col("raw") > F.col("cap")).alias("n_capped"))


@query(with_views("SELECT psid, round(q, 6) AS cap, count(*) FILTER (WHERE intensity > q) AS n_capped FROM points JOIN (SELECT psid, quantile_cont(intensity, 0.95) AS q FROM points GROUP BY psid) USING (psid) GROUP BY psid, q", "points"))
def outlier_cap_q95_by_flightline(spark, sf):
    p = V.points(spark, sf)
    q = p.groupBy("psid").agg(F.percentile("intensity", 0.95).alias("q"))
    return p.join(F.broadcast(q), "psid").groupBy("psid").agg(F.round(F.first("q"), 6).alias("cap"), F.count_if(F.col("intensity") > F.col("q")).alias("n_capped"))


for _name, _how, _skip, _sql in (("block_mean_2x", "mean", True, "round(avg(v), 6)"), ("block_mean_2x_whole", "mean", False, "CASE WHEN count(v) = 4 THEN round(avg(v), 6) END"), ("block_min_2x", "min", True, "round(min(v), 6)")):

    @query(with_views(f"SELECT CAST(floor(cx / 2) AS INT) AS cx, CAST(floor(cy / 2) AS INT) AS cy, {_sql} AS v FROM cells GROUP BY 1, 2", "cells"), _name)
    def _block(spark, sf, how=_how, skip=_skip):
        return R.block(V.cells(spark, sf), 2, how, skip).withColumn("v", F.round("v", 6))


def sql_lines(agg: str, cap_points: str | None, cap_cells: bool, across: str, scaled: bool, src: str, res: int) -> str:
    more = {"s": f"SELECT * FROM {src}"}
    if cap_points:
        more["s"] = f"SELECT p.* REPLACE (least(CAST({cap_points} AS DOUBLE), q) AS {cap_points}) FROM {src} p JOIN (SELECT psid, quantile_cont({cap_points}, 0.95) AS q FROM {src} GROUP BY psid) USING (psid)"
    more["l"] = f"SELECT psid, CAST(floor(x / {res}) AS INT) AS cx, CAST(floor(y / {res}) AS INT) AS cy, {agg} AS v FROM s GROUP BY 1, 2, 3"
    more["m"] = "SELECT psid, cx, cy, least(v, q) AS v FROM l JOIN (SELECT psid, quantile_cont(v, 0.95) AS q FROM l GROUP BY psid) USING (psid)" if cap_cells else "SELECT * FROM l"
    more["t"] = "SELECT psid, cx, cy, CASE WHEN v IS NOT NULL THEN least(coalesce((v - lo) / nullif(hi - lo, 0), 0), 1) END AS v FROM m JOIN (SELECT psid, min(v) AS lo, max(v) AS hi FROM m GROUP BY psid) USING (psid)" if scaled else "SELECT * FROM m"
    return with_views(f"SELECT cx, cy, round({across}(v), 6) AS v FROM t GROUP BY cx, cy", "np", **more)


@query(sql_lines("max(intensity) - min(intensity)", "intensity", False, "max", True, "np", 2))
def flightline_intensity_range(spark, sf):
    return R.by_flightline(normal(spark, sf), 2, F.max("intensity") - F.min("intensity"), "intensity").withColumn("v", F.round("v", 6))


@query(sql_lines("CAST(count(*) AS DOUBLE) / 4", None, True, "max", True, "(SELECT * FROM np WHERE cls = 2)", 2))
def flightline_density_ground(spark, sf):
    return R.by_flightline(P.trim_angles(normal(spark, sf).where("cls = 2"), 0), 2, F.count("*") / 4.0, "cell").withColumn("v", F.round("v", 6))


@query(sql_lines("CAST(count(*) AS DOUBLE)", None, True, "max", True, "(SELECT * FROM np WHERE zn > 0.5 AND zn < 3)", 2))
def flightline_density_lowpoints(spark, sf):
    return R.by_flightline(P.low_points(normal(spark, sf)), 2, F.count("*").cast("double"), "cell").withColumn("v", F.round("v", 6))


@query(sql_lines("CASE WHEN count(*) FILTER (WHERE zn > 0.5 AND zn < 3) <= 3 THEN 1 ELSE 0 END", None, False, "min", False, "np", 2))
def flightline_lowpoint_flag(spark, sf):
    n = F.count_if((F.col("zn") > 0.5) & (F.col("zn") < 3))
    return R.by_flightline(normal(spark, sf), 2, F.when(n <= 3, 1).otherwise(0), None, "min", False).withColumn("v", F.round("v", 6))


@query("WITH w AS (" + sql_lines("max(zn)", None, False, "min", False, "np", 2) + ") SELECT cx, cy, round(v - (SELECT min(v) FROM w), 6) AS v FROM w")
def flightline_chm(spark, sf):
    c = R.by_flightline(normal(spark, sf), 2, F.max("zn"), None, "min", False)
    return c.crossJoin(F.broadcast(c.agg(F.min("v").alias("lo")))).select("cx", "cy", F.round(F.col("v") - F.col("lo"), 6).alias("v"))


@query(with_views("SELECT cls, count(*) AS n FROM points WHERE abs(angle) < (SELECT max(abs(angle)) FROM points) - 3 GROUP BY cls", "points"))
def scan_angle_trim(spark, sf):
    return P.trim_angles(V.points(spark, sf), 3).groupBy("cls").agg(F.count("*").alias("n"))


@query(with_views("SELECT psid, count(*) AS n FROM np WHERE zn > 0.5 AND zn < 3 GROUP BY psid", "np"))
def height_band(spark, sf):
    return P.low_points(normal(spark, sf)).groupBy("psid").agg(F.count("*").alias("n"))


@query(with_views("SELECT psid, cls, count(*) AS n FROM points WHERE cls IN (2, 9) GROUP BY psid, cls", "points"))
def ground_and_water(spark, sf):
    return V.points(spark, sf).where(F.col("cls").isin(2, 9)).groupBy("psid", "cls").agg(F.count("*").alias("n"))


FOCAL = "CASE WHEN count(v) = {n} THEN round(avg(v), 6) END"
SQL_RESIDUAL = "SELECT cx, cy, cells.v - s.v AS v FROM cells JOIN s USING (cx, cy)"


@query(with_views(sql_window("cells", 2, FOCAL.format(n=25)), "cells"))
def focal_mean_5x5(spark, sf):
    return R.focal_mean(V.cells(spark, sf), 5, whole=True).withColumn("v", F.round("v", 6))


@query(with_views(sql_window("cells", 1, "round(avg(v), 6)"), "cells"))
def focal_mean_3x3(spark, sf):
    return R.focal_mean(V.cells(spark, sf), 3, whole=False).withColumn("v", F.round("v", 6))


@query(with_views(sql_window("cells", 1, "round(avg(CASE WHEN dx = 0 AND dy = 0 THEN 2 * v ELSE v END), 6)"), "cells"))
def focal_weighted_3x3(spark, sf):
    return R.focal_mean(V.cells(spark, sf), 3, whole=False, centre=2).withColumn("v", F.round("v", 6))


def residual(c):
    smooth = R.focal_mean(c, 5, whole=True).withColumnRenamed("v", "s")
    return c.join(smooth, ["cx", "cy"]).select("cx", "cy", (F.col("v") - F.col("s")).alias("v"))


ROUGH = "CASE WHEN count(v) = 9 THEN round(max(v) - min(v), 6) END"


@query(with_views(sql_window("r", 1, ROUGH), "cells", s=sql_window("cells", 2, "CASE WHEN count(v) = 25 THEN avg(v) END"), r=SQL_RESIDUAL))
def residual_roughness(spark, sf):
    return R.roughness(residual(V.cells(spark, sf))).withColumn("v", F.round("v", 6))


GX = f"(({at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(-1, 0)} - {at(-1, 1)}) / 8)"
GY = f"(({at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(0, -1)} - {at(1, -1)}) / 8)"
SLOPE = f"degrees(atan(sqrt({GX} * {GX} + {GY} * {GY})))"


@query(with_views(sql_window("cells", 1, f"round({SLOPE}, 6)"), "cells"))
def terrain_slope(spark, sf):
    return R.slope(V.cells(spark, sf)).withColumn("v", F.round("v", 6))


def _sobel_sum(size: int, across: bool) -> str:
    k, h = R.SOBEL[size], size // 2
    return "(" + " + ".join(f"{k[dx + h if across else dy + h][dy + h if across else dx + h]} * coalesce({at(dx, dy)}, 0)" for dx in range(-h, h + 1) for dy in range(-h, h + 1)) + ")"


def sql_sobel(size: int, digits: int = 6) -> str:
    a, b = _sobel_sum(size, False), _sobel_sum(size, True)
    return f"CASE WHEN {at(0, 0)} IS NOT NULL THEN round(sqrt({a} * {a} + {b} * {b}), {digits}) END"


for _size in (3, 5):

    @query(with_views(sql_window("cells", _size // 2, sql_sobel(_size)), "cells"), f"sobel_edges_{_size}")
    def _sobel(spark, sf, size=_size):
        return R.sobel(V.cells(spark, sf), size).withColumn("v", F.round("v", 6))


@query(with_views("SELECT psid, CAST(floor(x) AS INT) AS cx, CAST(floor(y) AS INT) AS cy, round((max(z) - any_value(lo)) / nullif(any_value(hi) - any_value(lo), 0), 6) AS v FROM points JOIN (SELECT psid, min(m) AS lo, max(m) AS hi FROM (SELECT psid, floor(x) AS a, floor(y) AS b, max(z) AS m FROM points GROUP BY ALL) GROUP BY psid) USING (psid) GROUP BY 1, 2, 3", "points"))
def band_stretch(spark, sf):
    return R.stretch(R.rasterize(V.points(spark, sf), 1, F.max("z").alias("v"), by=["psid"]), ["psid"]).select("psid", "cx", "cy", F.round("v", 6).alias("v"))


@query(with_views("SELECT CAST(x AS INT) AS cx, CAST(y AS INT) AS cy, v FROM range(-5, 61) a(x), range(10, 41) b(y) LEFT JOIN cells ON cx = x AND cy = y", "cells"))
def crop_extend(spark, sf):
    return R.fill_extent(V.cells(spark, sf), -5, 60, 10, 40)


INSIDE = f"EXISTS (SELECT 1 FROM water WHERE {CENTRE[0]} > x0 AND {CENTRE[0]} < x1 AND {CENTRE[1]} > y0 AND {CENTRE[1]} < y1)"


def cells_in_water(spark, sf):
    c = V.cells(spark, sf).withColumn("pid", F.struct("cx", "cy"))
    inside = in_polygons(c.select("pid", (F.col("cx") + 0.5).cast("double").alias("px"), (F.col("cy") + 0.5).cast("double").alias("py")), boxes_to_edges(V.water(spark, sf)))
    return c, inside.select("pid").distinct()


@query(with_views(f"SELECT cx, cy, v FROM cells WHERE {INSIDE}", "cells", "water"))
def mask_inside_polygon(spark, sf):
    c, w = cells_in_water(spark, sf)
    return c.join(w, "pid", "left_semi").select("cx", "cy", "v")


@query(with_views(f"SELECT cx, cy, CASE WHEN {INSIDE} THEN NULL ELSE v END AS v FROM cells", "cells", "water"))
def mask_outside_polygon(spark, sf):
    c, w = cells_in_water(spark, sf)
    return c.join(w.withColumn("wet", F.lit(1)), "pid", "left").select("cx", "cy", F.when(F.col("wet").isNull(), F.col("v")).alias("v"))


@query(with_views("SELECT CASE WHEN wet AND zn > 2 THEN 17 WHEN wet THEN 9 ELSE cls END AS cls, count(*) AS n FROM (SELECT *, EXISTS (SELECT 1 FROM water WHERE x > x0 AND x < x1 AND y > y0 AND y < y1) AS wet FROM np) GROUP BY 1", "np", "water"))
def water_bridge_reclass(spark, sf):
    p = normal(spark, sf)
    places = p.select(F.struct("x", "y").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    wet = in_polygons(places, boxes_to_edges(V.water(spark, sf))).select("pid").distinct().select("pid.x", "pid.y", F.lit(True).alias("wet"))
    cls = F.when(F.col("wet") & (F.col("zn") > 2), P.BRIDGE).when(F.col("wet"), P.WATER).otherwise(F.col("cls"))
    return p.join(wet, ["x", "y"], "left").groupBy(cls.alias("cls")).agg(F.count("*").alias("n"))


for _name, _spark, _sql in (
    ("linear_asc", lambda: S.activation_linear(F.col("z"), 1, 4), sql_linear("z", 1, 4)),
    ("linear_desc", lambda: S.activation_linear(F.col("z"), 1, 4, False), sql_linear("z", 1, 4, False)),
    ("threshold", lambda: S.activation_steps(F.when(F.col("z") < 4.8, F.col("z")), (1, 2.5, 4)), sql_steps("(CASE WHEN z < 4.8 THEN z END)", (1, 2.5, 4))),
    ("threshold_desc", lambda: S.activation_steps(F.col("z"), (2,), False), sql_steps("z", (2,), False)),
):

    @query(with_views(f"SELECT z, {_sql} AS a, count(*) AS n FROM points GROUP BY 1, 2", "points"), f"activation_{_name}")
    def _activation(spark, sf, a=_spark):
        return V.points(spark, sf).groupBy("z", a().alias("a")).agg(F.count("*").alias("n"))


SQL_Q = "SELECT quantile_cont(v, [" + ", ".join(str(i / 11) for i in range(12)) + "]) AS q FROM cells"


@query(with_views("SELECT cx, cy, round(1 - (k - min(k) OVER ()) / nullif(CAST(max(k) OVER () - min(k) OVER () AS DOUBLE), 0), 6) AS v FROM (SELECT cx, cy, " + " + ".join(f"CAST(v >= q[{i}] AS INT)" for i in range(1, 13)) + " AS k FROM cells, q)", "cells", q=SQL_Q))
def activation_quantile(spark, sf):
    c = V.cells(spark, sf)
    q = c.agg(F.percentile("v", [i / 11 for i in range(12)]).alias("q"))
    k = c.crossJoin(F.broadcast(q)).select("cx", "cy", S.interval(F.col("v"), F.col("q"), 12).alias("k"))
    ends = k.agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return k.crossJoin(F.broadcast(ends)).select("cx", "cy", F.round(1 - F.try_divide(F.col("k") - F.col("lo"), F.col("hi") - F.col("lo")), 6).alias("v"))


def sql_adjacent() -> str:
    return 'SELECT a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS "by", a.v AS va, b.v AS vb, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) AS dist FROM cells a, (VALUES (1, -1), (1, 0), (1, 1), (0, 1)) o(dx, dy), cells b WHERE b.cx = a.cx + dx AND b.cy = a.cy + dy'


@query(with_views("SELECT * REPLACE (round(dist, 6) AS dist) FROM e", "cells", e=sql_adjacent()))
def cell_adjacency(spark, sf):
    return R.adjacency(V.cells(spark, sf)).withColumn("dist", F.round("dist", 6))


@query(with_views("SELECT ax, ay, bx, \"by\", round((va + vb) / 2 / (dist * 2), 6) AS w FROM e WHERE va + vb > 0", "cells", e=sql_adjacent()))
def conductance_edges(spark, sf):
    return R.conductance(V.cells(spark, sf), res=2).withColumn("w", F.round("w", 6))


LOW = "SELECT psid, CAST(floor(x / 5) AS INT) AS cx, CAST(floor(y / 5) AS INT) AS cy, min(z) AS z FROM {src} GROUP BY ALL"
OFFSETS = "SELECT a.psid AS i, b.psid AS j, round(round(avg(a.z - b.z), 9), 3) AS \"offset\", count(*) AS n FROM low a JOIN low b USING (cx, cy) WHERE a.psid <> b.psid GROUP BY 1, 2"


@query(with_views('SELECT i, j, "offset", n FROM o', "points", low=LOW.format(src="points"), o=OFFSETS))
def flightline_offsets(spark, sf):
    return P.flightline_offsets(V.points(spark, sf))


#: As if flightlines more than two apart had no common ground.
FILL = """SELECT i, j, round(round(sum(o * w) / sum(w), 9), 3) AS "offset", round(avg(w), 6) AS n FROM (
 SELECT a.i AS i, b.j AS j, a."offset" + b."offset" AS o, (a.n + b.n) / 2 AS w FROM s a JOIN s b ON a.j = b.i WHERE a.i <> b.j
 UNION ALL SELECT a.i, c.j, a."offset" + b."offset" + c."offset", (a.n + b.n + c.n) / 3 FROM s a JOIN s b ON a.j = b.i JOIN s c ON b.j = c.i WHERE a.i <> b.j AND a.i <> c.j AND a.j <> c.j) t
 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.i = t.i AND s.j = t.j) GROUP BY i, j"""


@query(with_views(FILL, "points", low=LOW.format(src="points"), o=OFFSETS, s="SELECT * FROM o WHERE abs(i - j) <= 2"))
def flightline_fill(spark, sf):
    p = V.points(spark, sf)
    return P.fill_offsets(P.flightline_offsets(p).where("abs(i - j) <= 2"), p)


@query(with_views("""SELECT psid, round(sum(round((z - coalesce(shift, 0)) / 0.01) * 0.01), 3) AS total, count(*) AS n FROM points LEFT JOIN (SELECT i AS psid, "offset" AS shift FROM o WHERE j = (SELECT i FROM (SELECT i, count(*) AS k, sum(abs("offset")) AS s FROM o GROUP BY i) ORDER BY CASE WHEN k < (SELECT count(DISTINCT psid) - 1 FROM points) THEN 1 ELSE 0 END, round(s, 6), i LIMIT 1)) USING (psid) GROUP BY psid""", "points", low=LOW.format(src="points"), o=OFFSETS))
def flightline_realign(spark, sf):
    p = V.points(spark, sf)
    return P.realign_heights(p, P.flightline_offsets(p)).groupBy("psid").agg(F.round(F.sum("z"), 3).alias("total"), F.count("*").alias("n"))


@query("""SELECT user_id, line, count(*) AS n FROM (SELECT user_id, CAST(1 + sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM
 (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2""")
def flightline_ids_by_gap(spark, sf):
    e = V.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return P.flightlines_by_gap(e, "t", 86400, "user_id", "event_id").groupBy("user_id", "line").agg(F.count("*").alias("n"))


@query(with_views("SELECT k, count(*) AS n, round(sum(x), 6) AS sx FROM points, (SELECT CAST(k AS INT) AS k FROM range(0, 4) t(k)) WHERE abs((x - 100) * cos(k * 0.5) + (y - 50) * sin(k * 0.5)) <= 20.005 AND abs((y - 50) * cos(k * 0.5) - (x - 100) * sin(k * 0.5)) <= 7.505 GROUP BY k", "points"))
def oriented_rectangle(spark, sf):
    p = V.points(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    return p.where(P.in_oriented_rectangle(p, F.lit(100.0), F.lit(50.0), F.col("k") * 0.5, 40.01, 15.01)).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sx"))


@query(with_views("SELECT psid, round(sum(round(((x - 100) * cos(0.3) + (y - 50) * sin(0.3)) / 0.01) * 0.01), 2) AS along, round(sum(round(((y - 50) * cos(0.3) - (x - 100) * sin(0.3)) / 0.01) * 0.01), 2) AS across, CAST(0 AS BIGINT) AS moved FROM points GROUP BY psid", "points"))
def rotate_and_back(spark, sf):
    p = V.points(spark, sf)
    c = F.lit(100.0), F.lit(50.0), F.lit(0.3)
    a, b = S.rotate(F.col("x"), F.col("y"), *c)
    r = p.withColumns({"a": a, "b": b})
    x, y = S.unrotate(F.col("a"), F.col("b"), *c)
    return r.groupBy("psid").agg(F.round(F.sum("a"), 2).alias("along"), F.round(F.sum("b"), 2).alias("across"), F.count_if(F.hypot(x - F.col("x"), y - F.col("y")) > 0.01).alias("moved"))
