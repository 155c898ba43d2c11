"""Queries over series and cross-road profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import scalar as S
from wayfold.operators import profiles as Q

from . import views as V
from .registry import query, sql_filled, sql_linear, sql_ma
from .views import with_views

ROUND = lambda c, n=6: F.round(c, n).alias(c)


@query(with_views("SELECT user_id, i, round(f, 6) AS v FROM (" + sql_filled("series", "user_id", "i", "v") + ")", "series"))
def na_interpolate(spark, sf):
    return Q.interpolate(V.series(spark, sf), ["user_id"], "i", "v", "f").select("user_id", "i", F.round("f", 6).alias("v"))


for _n in (3, 12):

    @query(with_views("SELECT user_id, i, round(ma, 6) AS v FROM (" + sql_ma("series", "user_id", "i", "v", _n, "ma") + ")", "series"), f"moving_average_{_n}")
    def _ma(spark, sf, n=_n):
        return Q.moving_average(V.series(spark, sf), ["user_id"], "i", "v", n, "ma").select("user_id", "i", F.round("ma", 6).alias("v"))


GROUND = {"g": sql_ma("g0", "slice_id", "xr", "sd_z", 3, "ssd_z")}
SQL_DERIV = """(CASE WHEN lead(xr) OVER w IS NULL THEN {y} ELSE lead({y}) OVER w END - CASE WHEN lag(xr) OVER w IS NULL THEN {y} ELSE lag({y}) OVER w END)
 / nullif(coalesce(lead(xr) OVER w, xr) - coalesce(lag(xr) OVER w, xr), 0)""".format(y="avg_z")
SLOPED = GROUND | {"gs": f"SELECT *, round(abs(degrees(atan({SQL_DERIV}))), 2) AS slope FROM g WINDOW w AS (PARTITION BY slice_id ORDER BY xr)"}


@query(with_views("SELECT slice_id, xr, n, round(avg_z, 6) AS avg_z, round(sd_z, 6) AS sd_z, round(ssd_z, 6) AS ssd_z FROM g", "g0", **GROUND))
def ground_profile(spark, sf):
    return Q.ground_profile(V.slice_points(spark, sf)).select("slice_id", "xr", "n", *(ROUND(c) for c in ("avg_z", "sd_z", "ssd_z")))


@query(with_views(f"SELECT slice_id, xr, round({SQL_DERIV}, 6) AS d FROM g WINDOW w AS (PARTITION BY slice_id ORDER BY xr)", "g0", **GROUND))
def derivative(spark, sf):
    g = Q.ground_profile(V.slice_points(spark, sf))
    return g.select("slice_id", "xr", F.round(Q.derivative(["slice_id"], "xr", "xr", "avg_z"), 6).alias("d"))


@query(with_views("SELECT slice_id, xr, slope FROM gs", "g0", **SLOPED))
def slope_degrees(spark, sf):
    return V.ground(spark, sf).select("slice_id", "xr", "slope")


VEG0 = """SELECT slice_id, xr, count(*) FILTER (WHERE cls = 2) AS ngnd, count(*) FILTER (WHERE z >= 2 AND z < 5) AS n2, count(*) FILTER (WHERE z >= 0.5 AND z < 5) AS n05, count(*) FILTER (WHERE z >= 0.1 AND z < 5) AS n01,
 count(*) AS npoint, count(*) FILTER (WHERE z < 5) AS nlow, max(intensity) - min(intensity) AS cvi, stddev_samp(z) AS sd_z FROM sp GROUP BY slice_id, xr"""
VEG = {"v0": VEG0, "v1": "SELECT *, coalesce(n2 / nullif(nlow, 0), 0) AS q2, coalesce(n05 / nullif(nlow, 0), 0) AS q05, coalesce(n01 / nullif(nlow, 0), 0) AS q01 FROM v0"}
for _k, _p in (("a", "2"), ("b", "05"), ("c", "01")):
    VEG[f"v{_k}"] = sql_ma(list(VEG)[-1], "slice_id", "xr", f"q{_p}", 3, f"pabove{_p}")
VEG_COLS = ("ngnd", "n2", "n05", "n01", "npoint", "nlow", "cvi")


@query(with_views(f"SELECT slice_id, xr, {', '.join(VEG_COLS)}, round(sd_z, 6) AS sd_z, round(pabove2, 6) AS pabove2, round(pabove05, 6) AS pabove05, round(pabove01, 6) AS pabove01 FROM vc", "sp", **VEG))
def veg_profile(spark, sf):
    return V.vegetation(spark, sf).select("slice_id", "xr", *VEG_COLS, *(ROUND(c) for c in ("sd_z", "pabove2", "pabove05", "pabove01")))


EDGES = "SELECT slice_id, CAST(-4.0 AS DOUBLE) - slice_id % 3 AS \"left\", CAST(4.0 AS DOUBLE) AS \"right\" FROM (SELECT DISTINCT slice_id FROM sp)"


def fixed_edges(spark, sf):
    s = V.slice_points(spark, sf).select("slice_id").distinct()
    return s.select("slice_id", (-4.0 - F.col("slice_id") % 3).alias("left"), F.lit(4.0).alias("right"))


@query(
    with_views(
        """SELECT slice_id, CASE WHEN n IS NULL THEN 0 ELSE p05 END AS p05, CASE WHEN n IS NULL THEN 100 ELSE p2 END AS p2, pground FROM e LEFT JOIN (
 SELECT slice_id, count(*) AS n, round(100 * count(*) FILTER (WHERE z > 0.5 AND z < 5) / nullif(count(*) FILTER (WHERE z < 5), 0), 1) AS p05, round(100 * count(*) FILTER (WHERE z > 2 AND z < 5) / nullif(count(*) FILTER (WHERE z < 5), 0), 1) AS p2,
 round(100 * count(*) FILTER (WHERE cls = 2) / count(*), 1) AS pground FROM sp JOIN e USING (slice_id) WHERE pos > "left" AND pos < "right" GROUP BY slice_id) USING (slice_id)""",
        "sp",
        e=EDGES,
    )
)
def slice_percentages(spark, sf):
    return Q.slice_percentages(V.slice_points(spark, sf), fixed_edges(spark, sf))


def centres(spark, sf):
    return V.slice_points(spark, sf).select("slice_id").distinct().select("slice_id", F.lit(0.0).alias("xc"))


CENTRES = {"c0": "SELECT DISTINCT slice_id, CAST(0 AS DOUBLE) AS xc FROM sp"}
SHOULDERS = SLOPED | CENTRES | {
    "ms": sql_ma("gs", "slice_id", "xr", "slope", 3, "ms"),
    "mc": "SELECT slice_id, CASE WHEN count(*) > 2 THEN arg_min(xr, (round(ms, 6), xr)) FILTER (WHERE ms IS NOT NULL) END AS moved FROM ms JOIN c0 USING (slice_id) WHERE xr BETWEEN xc - 2 AND xc + 2 GROUP BY slice_id",
    "c1": "SELECT slice_id, coalesce(moved, xc) AS xc FROM c0 LEFT JOIN mc USING (slice_id)",
    "o": "SELECT *, row_number() OVER (PARTITION BY slice_id, side ORDER BY abs(xr - xc), xr) AS k FROM (SELECT gs.*, xc, 'left' AS side FROM gs JOIN c1 USING (slice_id) WHERE xr <= xc UNION ALL SELECT gs.*, xc, 'right' FROM gs JOIN c1 USING (slice_id) WHERE xr >= xc)",
    "p": "SELECT *, min(k) FILTER (WHERE slope >= 10) OVER w AS f, max(k) OVER w AS l FROM o WINDOW w AS (PARTITION BY slice_id, side)",
    "q": "SELECT *, coalesce(f, l) AS s, coalesce(min(k) FILTER (WHERE slope <= 10 AND k >= f) OVER (PARTITION BY slice_id, side), coalesce(f, l)) AS e FROM p",
    "t": """SELECT slice_id, side, max(xr) FILTER (WHERE k = s) AS "start", max(xr) FILTER (WHERE k = e) AS "end", max(avg_z) FILTER (WHERE k = e) - max(avg_z) FILTER (WHERE k = s) AS dz FROM q GROUP BY slice_id, side""",
    "u": """SELECT *, abs("end" - "start") AS width, coalesce(round(degrees(atan(abs(dz) / nullif(abs("end" - "start"), 0))), 2), 0) AS slope FROM t""",
}


@query(with_views("""SELECT slice_id, side, "start", "end", round(dz, 6) AS dz, slope, width, width >= 1 AND slope >= 10 AS embankment FROM u""", "g0", **SHOULDERS))
def shoulders(spark, sf):
    return Q.shoulders(V.ground(spark, sf), centres(spark, sf)).withColumn("dz", F.round("dz", 6))


def sql_out(src: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY slice_id, side ORDER BY abs(xr - xc), xr) AS k FROM (SELECT s.*, xc, 'left' AS side FROM {src} s JOIN c0 USING (slice_id) WHERE xr <= xc UNION ALL SELECT s.*, xc, 'right' FROM {src} s JOIN c0 USING (slice_id) WHERE xr >= xc)"


def sql_first(stop: str) -> str:
    return f"SELECT slice_id, side, coalesce(arg_min(xr, k) FILTER (WHERE {stop}), arg_max(xr, k)) AS edge FROM o GROUP BY slice_id, side"


SIDES = """max(edge) FILTER (WHERE side = 'left') AS "left", max(edge) FILTER (WHERE side = 'right') AS "right" """


@query(
    with_views(
        f"SELECT slice_id, {SIDES} FROM c0 LEFT JOIN e USING (slice_id) GROUP BY slice_id",
        "g0",
        **GROUND,
        **CENTRES,
        m=sql_ma("g", "slice_id", "xr", "avg_z", 3, "mz"),
        z="SELECT slice_id, arg_min(mz, (abs(xr - xc), xr)) FILTER (WHERE mz IS NOT NULL) AS z0 FROM m JOIN c0 USING (slice_id) GROUP BY slice_id",
        n="SELECT m.*, z0 FROM m JOIN z USING (slice_id)",
        o=sql_out("n"),
        e=sql_first("coalesce(ssd_z > 1.4 OR abs(mz - z0) > 0.4, true)"),
    )
)
def road_edges(spark, sf):
    return Q.road_edges(Q.ground_profile(V.slice_points(spark, sf)), centres(spark, sf), 1.4, 0.4)


@query(
    with_views(
        f"""SELECT slice_id, {SIDES}, CASE WHEN any_value(n) > 1 THEN coalesce(max(edge) FILTER (WHERE side = 'right') - max(edge) FILTER (WHERE side = 'left'), 0) ELSE 0 END AS width
 FROM d LEFT JOIN e USING (slice_id) LEFT JOIN (SELECT slice_id, count(*) AS n FROM b GROUP BY slice_id) USING (slice_id) GROUP BY slice_id""",
        "sp",
        **VEG,
        **CENTRES,
        d=EDGES,
        b='SELECT slice_id, xr, pabove05 FROM vc JOIN d USING (slice_id) WHERE xr BETWEEN "left" AND "right"',
        o=sql_out("b"),
        e=sql_first("coalesce(pabove05 > 0.95, false)"),
    )
)
def drivable_edges(spark, sf):
    return Q.drivable_edges(V.vegetation(spark, sf), fixed_edges(spark, sf), centres(spark, sf), 0.95)


def sql_det(a: str, b: str, c: str, d: str, e: str, f: str, g: str, h: str, i: str) -> str:
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def sql_quadratic(src: str, x: str, y: str) -> dict[str, str]:
    den = sql_det("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
    fine = f"CASE WHEN abs({den}) > 1e-6 THEN {den} END"
    return {
        "qm": f"SELECT slice_id, {x} - avg({x}) OVER w AS u, avg({x}) OVER w AS mean, CAST({y} AS DOUBLE) AS v FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL WINDOW w AS (PARTITION BY slice_id)",
        "qs": "SELECT slice_id, any_value(mean) AS mean, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(v) AS t0, sum(u * v) AS t1, sum(u * u * v) AS t2 FROM qm GROUP BY slice_id",
        "qf": f"SELECT slice_id, mean, {sql_det('t0', 's1', 's2', 't1', 's2', 's3', 't2', 's3', 's4')} / {fine} AS c0, {sql_det('n', 't0', 's2', 's1', 't1', 's3', 's2', 't2', 's4')} / {fine} AS c1, {sql_det('n', 's1', 't0', 's1', 's2', 't1', 's2', 's3', 't2')} / {fine} AS c2 FROM qs",
    }


@query(with_views("SELECT slice_id, round(mean, 4) AS mean, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2 FROM qf", "g0", **sql_quadratic("g0", "xr", "avg_z")))
def quadratic_fit(spark, sf):
    g = Q.ground_profile(V.slice_points(spark, sf))
    return Q.quadratic(g, "slice_id", "xr", "avg_z").select("slice_id", *(ROUND(c, 4) for c in ("mean", "c0", "c1", "c2")))


SHIFT = dict(VEG)
for _v, _m in (("sd_z", "m1"), ("ngnd", "m2"), ("cvi", "m3")):
    SHIFT[f"w{_m}"] = sql_ma(list(SHIFT)[-1], "slice_id", "xr", _v, 12, _m)
SHIFT |= {
    "sh": "SELECT slice_id, xr, m1 / nullif(max(m1) OVER w, 0) AS a, m2 / nullif(max(m2) OVER w, 0) AS b, m3 / nullif(max(m3) OVER w, 0) AS c FROM wm3 WHERE xr BETWEEN -7 AND 7 WINDOW w AS (PARTITION BY slice_id)",
    "sc": "SELECT slice_id, xr, a + 2 * (1 - (b - min(b) OVER (PARTITION BY slice_id))) + c AS score FROM sh",
}
SHIFT |= sql_quadratic("sc", "xr", "score")


@query(
    with_views(
        "SELECT slice_id, round(CASE WHEN n > 3 AND c2 > 1e-9 AND abs(mean - c1 / (2 * c2)) < 5 THEN least(greatest(mean - c1 / (2 * c2), lo), hi) ELSE 0 END, 4) AS xc FROM (SELECT slice_id, count(score) AS n, min(xr) AS lo, max(xr) AS hi FROM sc GROUP BY slice_id) LEFT JOIN qf USING (slice_id)",
        "sp",
        **SHIFT,
    )
)
def centreline_shift(spark, sf):
    return Q.centreline_shift(V.vegetation(spark, sf)).select("slice_id", F.round("xc", 4).alias("xc"))


SLICES = """SELECT l_orderkey % 500 AS road_id, l_quantity / 5 AS road_width, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity / 8 END AS drivable_width, l_tax * 400 AS pzabove05, CAST(l_linenumber % 3 AS INT) AS shoulders FROM lineitem"""


def slice_metrics(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("road_id"),
        (F.col("l_quantity") / 5).alias("road_width"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") / 8).alias("drivable_width"),
        (F.col("l_tax") * 400).alias("pzabove05"),
        (F.col("l_linenumber") % 3).cast("int").alias("shoulders"),
    )


def sql_metrics(strict: bool) -> str:
    def mean(c: str, more: str = "") -> str:
        m = f"round(round(avg({c}){more}, 9), 1)"
        return f"CASE WHEN count({c}) = count(*) THEN {m} END" if strict else m

    return f"SELECT road_id, {mean('road_width')} AS ROADWIDTH, {mean('drivable_width')} AS DRIVABLEWIDTH, {mean('pzabove05')} AS PERCABOVEROAD, {mean('shoulders', ' / 2 * 100')} AS SHOULDERS FROM s GROUP BY road_id"


for _strict in (False, True):

    @query(with_views(sql_metrics(_strict), s=SLICES), "road_metrics" + "_strict" * _strict)
    def _metrics(spark, sf, strict=_strict):
        return Q.road_metrics(slice_metrics(spark, sf), strict)


_PARTS = (sql_linear('"PERCABOVEROAD"', 10, 40, False), sql_linear('"DRIVABLEWIDTH"', 1, 5), sql_linear("c", 0.25, 0.5), sql_linear('"SHOULDERS"', 50, 75))


@query(with_views("SELECT road_id, score, CASE WHEN score < 25 THEN 4 WHEN score < 50 THEN 3 WHEN score < 75 THEN 2 WHEN score <= 101 THEN 1 END AS class FROM (SELECT road_id, round(round(100 * (" + " + ".join(_PARTS) + ") / 4, 9), 1) AS score FROM (SELECT *, (road_id % 100) / 100 AS c FROM m))", s=SLICES, m=sql_metrics(False)))
def road_score_class(spark, sf):
    m = Q.road_metrics(slice_metrics(spark, sf)).withColumn("c", (F.col("road_id") % 100) / 100)
    s = m.select("road_id", S.road_score(F.col("PERCABOVEROAD"), F.col("DRIVABLEWIDTH"), F.col("c"), F.col("SHOULDERS")).alias("score"))
    return s.withColumn("class", S.road_class(F.col("score")))
