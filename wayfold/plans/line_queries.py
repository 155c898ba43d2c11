"""Queries over lines, road networks, and plain joins and sets of road tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import scalar as S
from wayfold.operators import lines as L
from wayfold.operators import network as N
from wayfold.operators import raster as R
from wayfold.operators.spatial import distance_to_segments

from . import views as V
from .registry import query
from .views import with_views



def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(with_views("SELECT line_id, seq, round(seg, 6) AS seg, round(m, 6) AS m FROM mv", "mv"))
def cumulative_length(spark, sf):
    return r6(L.measured(V.vertices(spark, sf)), "seg", "m").select("line_id", "seq", "seg", "m")


@query(with_views("SELECT line_id, round(length, 6) AS length FROM lens", "lens"))
def line_length(spark, sf):
    return r6(L.lengths(V.vertices(spark, sf)), "length")


@query(with_views("SELECT line_id, is_end, x, y FROM ends", "ends"))
def line_ends(spark, sf):
    return L.ends(V.vertices(spark, sf))


CHORDS = "SELECT line_id, arg_min(x, seq) AS x1, arg_min(y, seq) AS y1, arg_max(x, seq) AS x2, arg_max(y, seq) AS y2 FROM {} GROUP BY line_id"


@query(with_views("SELECT line_id, round(length / nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 2) AS sinuosity FROM lens JOIN c USING (line_id)", "lens", c=CHORDS.format("vertices")))
def sinuosity(spark, sf):
    return L.sinuosity(V.vertices(spark, sf))


HEADINGS = """SELECT line_id, degrees(atan2(max(y) FILTER (WHERE a = 1) - max(y) FILTER (WHERE a = 2), max(x) FILTER (WHERE a = 1) - max(x) FILTER (WHERE a = 2))) AS head,
 degrees(atan2(max(y) FILTER (WHERE b = 1) - max(y) FILTER (WHERE b = 2), max(x) FILTER (WHERE b = 1) - max(x) FILTER (WHERE b = 2))) AS tail FROM
 (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS a, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) AS b FROM vertices) GROUP BY line_id"""


@query(with_views("SELECT line_id, round(head, 6) AS head, round(tail, 6) AS tail FROM h", "vertices", h=HEADINGS))
def end_headings(spark, sf):
    return r6(L.headings(V.vertices(spark, sf)), "head", "tail")


ANGLES = """SELECT line_id, seq, CASE WHEN r > 0.999999999 THEN 0 ELSE degrees(acos(greatest(r, -1))) END AS angle FROM (SELECT line_id, seq,
 (ux * vx + uy * vy) / nullif(sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy), 0) AS r FROM (SELECT line_id, seq, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE ux IS NOT NULL AND vx IS NOT NULL)"""


@query(with_views("SELECT line_id, seq, round(angle, 5) AS angle FROM a", "vertices", a=ANGLES))
def turning_angles(spark, sf):
    return L.turning_angles(V.vertices(spark, sf)).withColumn("angle", F.round("angle", 5))


@query(with_views("SELECT line_id, count(*) FILTER (WHERE angle > 90) AS n, round(max(angle), 5) AS sharpest FROM a GROUP BY line_id HAVING max(angle) > 90", "vertices", a=ANGLES))
def sharp_turns(spark, sf):
    a = L.turning_angles(V.vertices(spark, sf))
    return a.groupBy("line_id").agg(F.count_if(F.col("angle") > 90).alias("n"), F.round(F.max("angle"), 5).alias("sharpest")).where("sharpest > 90")


@query(with_views("SELECT line_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) < 25 AS is_loop, length < 40 AS too_short FROM c JOIN lens USING (line_id)", "lens", c=CHORDS.format("vertices")))
def loop_and_short_flags(spark, sf):
    v = V.vertices(spark, sf)
    return L.chords(v).join(L.lengths(v), "line_id").select("line_id", (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) < 25).alias("is_loop"), (F.col("length") < 40).alias("too_short"))


@query(with_views("SELECT line_id, round(CASE WHEN d < 160 THEN d * 80 / 165 ELSE 80 END, 6) AS buffer, CAST(floor(length / 200) AS INT) + CASE WHEN d < 25 AND floor(length / 200) = 0 THEN 1 ELSE 0 END + 1 AS pieces FROM (SELECT line_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS d FROM c) JOIN lens USING (line_id)", "lens", c=CHORDS.format("vertices")))
def buffer_and_pieces(spark, sf):
    v = V.vertices(spark, sf)
    c = L.chords(v).withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).join(L.lengths(v), "line_id")
    return c.select("line_id", F.round(S.buffer_near_closed(F.col("d"), 80), 6).alias("buffer"), S.split_count(F.col("length"), 200, F.col("d") < 25).alias("pieces"))


def sql_locate(cuts: str) -> str:
    """cuts: (line_id, k, m)."""
    t = "coalesce((m - m1) / nullif(m2 - m1, 0), 0)"
    return f"SELECT line_id, k, m, arg_min(x1 + {t} * (x2 - x1), seq) AS x, arg_min(y1 + {t} * (y2 - y1), seq) AS y FROM segs JOIN {cuts} USING (line_id) WHERE m >= m1 AND (m < m2 OR m <= m2 AND m2 = len) GROUP BY ALL"


@query(with_views("SELECT line_id, k, round(x, 5) AS x, round(y, 5) AS y FROM p", "segs", "lens", c="SELECT line_id, k, length * k / 3 AS m FROM lens, (SELECT CAST(k AS INT) AS k FROM range(0, 3) t(k))", p=sql_locate("c")))
def locate_point(spark, sf):
    v = V.vertices(spark, sf)
    at = L.lengths(v).select("line_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k"), "length").select("line_id", "k", (F.col("length") * F.col("k") / 3).alias("m"))
    return L.locate(v, at).select("line_id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(with_views("SELECT line_id, seq, round(x + coalesce(10 * cos(radians(a)), 0), 6) AS x, round(y + coalesce(10 * sin(radians(a)), 0), 6) AS y FROM (SELECT *, CASE WHEN seq = min(seq) OVER w THEN head WHEN seq = max(seq) OVER w THEN tail END AS a FROM vertices JOIN h USING (line_id) WINDOW w AS (PARTITION BY line_id))", "vertices", h=HEADINGS))
def extend_line(spark, sf):
    return r6(L.extend(V.vertices(spark, sf), 10), "x", "y")


@query(with_views("""SELECT line_id, part, row_number() OVER (PARTITION BY line_id, part ORDER BY m, x, y) AS seq, round(x, 5) AS x, round(y, 5) AS y FROM (
 SELECT line_id, CASE WHEN m < length * 0.37 THEN 1 ELSE 2 END AS part, m, x, y FROM mv JOIN lens USING (line_id) WHERE m <> length * 0.37 UNION ALL SELECT line_id, CAST(part AS INT), m, x, y FROM p, range(1, 3) r(part))""", "segs", "lens", c="SELECT line_id, 0 AS k, length * 0.37 AS m FROM lens", p=sql_locate("c")))
def split_at_measure(spark, sf):
    v = V.vertices(spark, sf)
    return L.split_at(v, L.lengths(v).select("line_id", (F.col("length") * 0.37).alias("m"))).withColumns({c: F.round(c, 5) for c in "xy"})


@query(with_views("""SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY m, x, y) AS seq, round(x, 5) AS x, round(y, 5) AS y FROM (
 SELECT line_id, m, x, y FROM mv JOIN lens USING (line_id) WHERE m > 0.2 * length AND m < 0.71 * length UNION ALL SELECT line_id, m, x, y FROM p)""", "segs", "lens", c="SELECT line_id, k, CASE k WHEN 0 THEN 0.2 * length ELSE 0.71 * length END AS m FROM lens, (VALUES (0), (1)) t(k)", p=sql_locate("c")))
def line_substring(spark, sf):
    return L.substring(V.vertices(spark, sf), F.lit(0.2), F.lit(0.71)).withColumns({c: F.round(c, 5) for c in "xy"})


@query(with_views("SELECT line_id, k, round(CASE WHEN k = n THEN length ELSE round(k * 10.0::DOUBLE / length, 4) * length END, 6) AS m FROM (SELECT line_id, length, CAST(greatest(floor(length / 10), 1) AS INT) AS n, unnest(range(0, CAST(greatest(floor(length / 10), 1) AS INT) + 1))::INT AS k FROM lens)", "lens"))
def equal_slices(spark, sf):
    return L.equal_cuts(V.vertices(spark, sf), 10.0).withColumn("m", F.round("m", 6))


RESAMPLE = "SELECT line_id, k, CASE WHEN k = 0 THEN 0 WHEN k > n THEN length ELSE (k - 0.5::DOUBLE) / n * length END AS m FROM (SELECT line_id, length, n, CAST(unnest(range(0, n + 2)) AS INT) AS k FROM (SELECT line_id, length, CAST(ceil(length / 25) AS INT) AS n FROM lens))"


@query(with_views("SELECT line_id, k, round(x, 5) AS x, round(y, 5) AS y FROM p", "segs", "lens", c=RESAMPLE, p=sql_locate("c")))
def resample_line(spark, sf):
    v = V.vertices(spark, sf)
    return L.samples(v, F.ceil(F.col("length") / 25).cast("int")).select("line_id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


NEAR_T = "greatest(0, least(1, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0)))"


@query(
    with_views(
        "SELECT line_id, pid, round(arg_min(m1 + t * (m2 - m1), (round(d, 9), seq)), 5) AS m, round(min(d), 5) AS dist FROM (SELECT *, sqrt((px - x1 - t * (x2 - x1)) * (px - x1 - t * (x2 - x1)) + (py - y1 - t * (y2 - y1)) * (py - y1 - t * (y2 - y1))) AS d FROM n) GROUP BY line_id, pid",
        "segs",
        "vertices_cor",
        n=f"SELECT segs.*, c.seq AS pid, c.x AS px, c.y AS py, {NEAR_T} AS t FROM segs JOIN (SELECT line_id, seq, x, y AS y FROM vertices_cor) c USING (line_id)",
    )
)
def nearest_on_line(spark, sf):
    p = V.vertices_cor(spark, sf).select("line_id", F.col("seq").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    return L.nearest_on_line(V.vertices(spark, sf), p).select("line_id", "pid", F.round("m", 5).alias("m"), F.round("dist", 5).alias("dist"))


@query(with_views("SELECT line_id, count(*) AS n FROM (SELECT *, x = lag(x) OVER w AND y = lag(y) OVER w AS same FROM (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY seq, k) AS seq, x, y FROM vertices, range(0, 2) r(k) WHERE k = 0 OR seq % 3 = 0) WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE NOT coalesce(same, false) GROUP BY line_id", "vertices"))
def drop_repeated_vertices(spark, sf):
    v = V.vertices(spark, sf).withColumn("k", F.explode(F.when(F.col("seq") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    v = v.withColumn("seq", F.row_number().over(Window.partitionBy("line_id").orderBy("seq", "k")).cast("bigint"))
    return L.without_repeats(v).groupBy("line_id").agg(F.count("*").alias("n"))


@query(
    with_views(
        "SELECT line_id, round(abs(sum(x * ny - nx * y) / 2) / nullif(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 0), 6) AS \"index\" FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ring WINDOW w AS (PARTITION BY line_id ORDER BY part, o)) GROUP BY line_id",
        "vertices",
        "vertices_cor",
        a=CHORDS.format("vertices"),
        b=CHORDS.format("vertices_cor"),
        f="SELECT line_id, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) <= sqrt((a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2) AS flip FROM a JOIN b USING (line_id)",
        ring="SELECT line_id, 0 AS part, seq AS o, x, y FROM vertices UNION ALL SELECT line_id, 1, CASE WHEN flip THEN -seq ELSE seq END, x, y FROM vertices_cor JOIN f USING (line_id)",
    )
)
def area_perimeter_index(spark, sf):
    return r6(L.difference_index(V.vertices(spark, sf), V.vertices_cor(spark, sf)), "index")


COR = {
    "mvc": V.SQL["mv"].replace("FROM vertices", "FROM vertices_cor"),
    "segc": V.SQL["segs"].replace("FROM mv", "FROM mvc"),
    "lenc": "SELECT line_id, max(m) AS length FROM mvc GROUP BY line_id",
    "nn": "SELECT line_id, CAST(ceil(length / 10) AS INT) AS n FROM lenc",
    "ca": "SELECT line_id, k, CASE WHEN k = 0 THEN 0 WHEN k > n THEN length ELSE (k - 0.5::DOUBLE) / n * length END AS m FROM (SELECT line_id, length, n, CAST(unnest(range(0, n + 2)) AS INT) AS k FROM lens JOIN nn USING (line_id))",
    "cb": "SELECT line_id, k, CASE WHEN k = 0 THEN 0 WHEN k > n THEN length ELSE (k - 0.5::DOUBLE) / n * length END AS m FROM (SELECT line_id, length, n, CAST(unnest(range(0, n + 2)) AS INT) AS k FROM lenc JOIN nn USING (line_id))",
    "pa": sql_locate("ca"),
    "pb": sql_locate("cb").replace("FROM segs", "FROM segc"),
}


@query(with_views("SELECT line_id, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.9), 4) AS p90, round(max(d), 4) AS p100, round(max(d) FILTER (WHERE k = 0 OR k > n), 4) AS end_max FROM (SELECT line_id, k, n, sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) AS d FROM pa JOIN pb USING (line_id, k) JOIN nn USING (line_id)) GROUP BY line_id", "segs", "lens", "vertices_cor", **COR))
def along_road_quantiles(spark, sf):
    d = L.along_distances(V.vertices(spark, sf), V.vertices_cor(spark, sf))
    return d.select("line_id", *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p100", "end_max")))


RING = {
    "a": CHORDS.format("vertices"),
    "b": CHORDS.format("vertices_cor"),
    "f": "SELECT line_id, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) <= sqrt((a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2) AS flip FROM a JOIN b USING (line_id)",
    "ring": "SELECT line_id, 0 AS part, seq AS o, x, y FROM vertices UNION ALL SELECT line_id, 1, CASE WHEN flip THEN -seq ELSE seq END, x, y FROM vertices_cor JOIN f USING (line_id)",
}
AREA = "SELECT line_id, round(abs(sum(x * ny - nx * y) / 2) / nullif(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 0), 6) AS area_over_perimeter FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ring WINDOW w AS (PARTITION BY line_id ORDER BY part, o)) GROUP BY line_id"
ALONG_SQL = "SELECT line_id, round(quantile_cont(d, 0.5), 4) AS p50, round(quantile_cont(d, 0.9), 4) AS p90, round(max(d), 4) AS p100, round(max(d) FILTER (WHERE k = 0 OR k > n), 4) AS end_max FROM (SELECT line_id, k, n, sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) AS d FROM pa JOIN pb USING (line_id, k) JOIN nn USING (line_id)) GROUP BY line_id"


@query(with_views("SELECT * FROM ar JOIN al USING (line_id)", "segs", "lens", "vertices_cor", **COR, **RING, ar=AREA, al=ALONG_SQL))
def road_differences(spark, sf):
    from wayfold.operators.roads import road_differences as differ

    d = differ(V.vertices_cor(spark, sf), V.vertices(spark, sf))
    return d.select("line_id", F.round("area_over_perimeter", 6).alias("area_over_perimeter"), *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p100", "end_max")))


@query("SELECT 'repeated' AS \"check\", count(*) AS n FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'unused', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def road_id_checks(spark, sf):
    c, o = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct()
    found = {"repeated": c.groupBy("id").count().where("count > 1"), "missing": o.join(c, "id", "left_anti"), "unused": c.join(o, "id", "left_anti")}
    out = None
    for k, df in found.items():
        one = df.agg(F.lit(k).alias("check"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


EIDS = "SELECT line_id * 2 + CAST(is_end AS INT) AS eid, line_id, is_end, x, y FROM ends"


def sql_pairs(radius: float) -> str:
    return f"SELECT a.eid AS aid, b.eid AS bid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\" FROM eids a JOIN eids b ON b.x BETWEEN a.x - {radius} AND a.x + {radius} AND b.y BETWEEN a.y - {radius} AND a.y + {radius} WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {radius}"


@query(with_views('SELECT aid, bid FROM p', "ends", eids=EIDS, p=sql_pairs(8)))
def within_distance_pairs(spark, sf):
    return N.end_pairs(V.vertices(spark, sf), 8).select("aid", "bid")


SETS = {"eids": EIDS, "p": sql_pairs(8), "m": 'SELECT aid, list(bid ORDER BY bid) AS ids FROM p GROUP BY aid HAVING count(*) > 1', "s": "SELECT DISTINCT ids FROM m",
        "f": "SELECT ids, avg(e.x) AS x, avg(e.y) AS y, count(*) FILTER (WHERE e.x = o.x AND e.y = o.y) AS near, count(*) AS n FROM (SELECT ids, ids[1] AS first_id, unnest(ids) AS id FROM s) JOIN eids e ON e.eid = id JOIN eids o ON o.eid = first_id GROUP BY ids"}


@query(with_views("SELECT round(x, 6) AS x, round(y, 6) AS y, CAST(near AS INT) AS nb_connected, CAST(n - near AS INT) AS nb_unconnected FROM f WHERE n > near", "ends", **SETS))
def missing_junctions(spark, sf):
    return r6(N.missing_junctions(V.vertices(spark, sf)), "x", "y")


@query(with_views('SELECT eid, round(arg_max(f.x, ids), 6) AS x, round(arg_max(f.y, ids), 6) AS y FROM eids e JOIN f ON f.x BETWEEN e.x - 8 AND e.x + 8 AND sqrt((f.x - e.x) * (f.x - e.x) + (f.y - e.y) * (f.y - e.y)) <= 8 GROUP BY eid', "ends", **SETS))
def snap_simple_ends(spark, sf):
    v = V.vertices(spark, sf)
    lines, _ = N.snap_simple(v, 8)
    new = N.numbered_ends(lines).select("eid", "x", "y")
    near = N.neighbour_sets(v, 8).select(F.col("ids").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    old = N.numbered_ends(v).select(F.col("eid").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by"))
    moved = N.within_distance(near, old, 8).select(F.col("bid").alias("eid")).distinct()
    return r6(new.join(moved, "eid", "left_semi"), "x", "y")


CROSS = """SELECT DISTINCT round(x1 + t * (x2 - x1), 6) AS x, round(y1 + t * (y2 - y1), 6) AS y FROM (SELECT a.x1, a.y1, a.x2, a.y2,
 (b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1) AS d1, (b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1) AS d2,
 (a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1) AS d3, (a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1) AS d4, d1 / (d1 - d2) AS t
 FROM segs a JOIN segs b ON a.line_id < b.line_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND floor(a.line_id / 100) BETWEEN floor(b.line_id / 100) - 1 AND floor(b.line_id / 100) + 1) WHERE d1 * d2 < 0 AND d3 * d4 < 0"""


@query(with_views(CROSS, "segs"))
def crossings(spark, sf):
    return N.check_crossings(V.vertices(spark, sf))


MEMBERS = {
    "h": HEADINGS,
    "n0": "SELECT CAST(CAST(round(x / 40) AS INT) AS VARCHAR) || '_' || CAST(CAST(round(y / 40) AS INT) AS VARCHAR) AS node, CAST(line_id AS VARCHAR) || '_' || CAST(is_end AS VARCHAR) AS id, line_id, CASE WHEN is_end THEN tail ELSE head END AS heading FROM ends JOIN h USING (line_id)",
    "n1": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY node) AS k FROM n0) WHERE k > 1",
    "n2": "SELECT node, id, heading, CASE WHEN class = 0 THEN 5 ELSE class END AS class, score FROM n1 LEFT JOIN roads USING (line_id)",
}


@query(with_views("SELECT node, id, class, score, round(heading, 6) AS heading FROM n2", "ends", "roads", **MEMBERS))
def node_members(spark, sf):
    m = N.node_members(V.vertices(spark, sf), V.roads(spark, sf), 40, 40)
    return m.select("node", "id", "class", "score", F.round("heading", 6).alias("heading"))


@query(
    with_views(
        """SELECT node, id1, id2 FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE WHEN angle >= top - 7.5 THEN 180 ELSE angle END DESC, c, s DESC, id1, id2) AS r FROM
 (SELECT *, max(angle) OVER (PARTITION BY node) AS top FROM (SELECT a.node, a.id AS id1, b.id AS id2, a.class + b.class AS c, round(a.score + b.score, 6) AS s, round(least(abs(a.heading - b.heading) % 360, 360 - abs(a.heading - b.heading) % 360), 6) AS angle
 FROM n2 a JOIN n2 b ON a.node = b.node AND a.id < b.id))) WHERE r = 1""",
        "ends",
        "roads",
        **MEMBERS,
    )
)
def best_connexion(spark, sf):
    return N.best_connexion(N.node_members(V.vertices(spark, sf), V.roads(spark, sf), 40, 40))


@query(
    with_views(
        "SELECT cx, cy, round(1 - coalesce((d - min(d) OVER ()) * 0.1 / nullif(max(d) OVER () - min(d) OVER (), 0), 0), 6) AS f FROM (SELECT cx, cy, min(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2)) AS d FROM n GROUP BY cx, cy) WHERE d <= 15",
        "segs",
        "cells",
        k="SELECT cx, cy, CAST(cx * 2 AS DOUBLE) + 0.5 AS px, CAST(cy * 2 AS DOUBLE) + 0.5 AS py FROM cells",
        n=f"SELECT k.*, segs.*, {NEAR_T} AS t FROM k JOIN segs ON px BETWEEN x1 - 15 AND x2 + 15 AND py BETWEEN least(y1, y2) - 15 AND greatest(y1, y2) + 15",
    )
)
def distance_factor(spark, sf):
    c = V.cells(spark, sf).select(F.struct("cx", "cy").alias("pid"), (F.col("cx") * 2 + 0.5).cast("double").alias("px"), (F.col("cy") * 2 + 0.5).cast("double").alias("py"))
    d = distance_to_segments(c, L.segments(V.vertices(spark, sf)), 15)
    return R.distance_factor(d, 0.1).select("pid.cx", "pid.cy", F.round("f", 6).alias("f"))


@query(with_views("SELECT e.line_id, e.is_end, class, score FROM ends e LEFT JOIN roads r ON r.line_id = e.line_id AND r.class <= 2", "ends", "roads"))
def ends_with_scores(spark, sf):
    return L.ends(V.vertices(spark, sf)).select("line_id", "is_end").join(V.roads(spark, sf).where("class <= 2"), "line_id", "left")


@query(with_views("SELECT line_id, 'kept' AS what FROM roads WHERE line_id IN (SELECT line_id FROM vertices) UNION ALL SELECT line_id, 'lost' FROM roads WHERE line_id NOT IN (SELECT line_id FROM vertices)", "roads", "vertices"))
def roads_with_and_without_lines(spark, sf):
    r, v = V.roads(spark, sf).select("line_id"), V.vertices(spark, sf).select("line_id")
    return r.join(v, "line_id", "left_semi").withColumn("what", F.lit("kept")).unionByName(r.join(v, "line_id", "left_anti").withColumn("what", F.lit("lost")))


@query(with_views("SELECT line_id, CASE class WHEN 4 THEN 0 END AS ROADWIDTH, CASE class WHEN 4 THEN 100 END AS PERCABOVEROAD, CASE class WHEN 4 THEN 0 END AS SCORE, CASE class WHEN 4 THEN 4 ELSE 0 END AS CLASS FROM (SELECT line_id, class FROM roads WHERE class IN (3, 4))", "roads"))
def default_road_rows(spark, sf):
    from wayfold.operators.roads import default_rows

    r = V.roads(spark, sf).where("class in (3, 4)").select("line_id", "class")
    four = F.col("class") == 4
    return default_rows(r, four).select("line_id", "ROADWIDTH", "PERCABOVEROAD", "SCORE", F.col("CLASS").alias("CLASS"))


@query(with_views("SELECT line_id, n, x0, y0 FROM (SELECT line_id, count(*) AS n, arg_max(x, seq) AS x0, arg_max(y, seq) AS y0 FROM vertices GROUP BY line_id)", "vertices"))
def reverse_lines(spark, sf):
    v = V.vertices(spark, sf)
    a = v.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    back = F.reverse("p")
    return a.select("line_id", F.size("p").cast("bigint").alias("n"), F.get(back, 0).x.alias("x0"), F.get(back, 0).y.alias("y0"))


@query(with_views("SELECT CAST(floor(line_id / 10) AS BIGINT) AS road, count(*) AS n, round(sum(sqrt((x - px) ** 2 + (y - py) ** 2)), 4) AS length FROM (SELECT line_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM vertices WINDOW w AS (PARTITION BY floor(line_id / 10) ORDER BY line_id, seq)) GROUP BY 1", "vertices"))
def merge_lines(spark, sf):
    v = V.vertices(spark, sf).withColumn("road", F.floor(F.col("line_id") / 10))
    w = Window.partitionBy("road").orderBy("line_id", "seq")
    merged = v.select(F.col("road").alias("line_id"), F.row_number().over(w).alias("seq"), "x", "y")
    return L.measured(merged).groupBy(F.col("line_id").alias("road")).agg(F.count("*").alias("n"), F.round(F.sum("seg"), 4).alias("length"))


@query(with_views("SELECT c.cx, c.cy, c.v, h.chm, d.n AS density FROM cells c LEFT JOIN (SELECT cx, cy, max(zn) AS chm FROM np GROUP BY 1, 2) h USING (cx, cy) LEFT JOIN (SELECT cx, cy, count(*) AS n FROM pc GROUP BY 1, 2) d USING (cx, cy)", "cells", "np"))
def raster_stack(spark, sf):
    from .raster_queries import normal

    c, chm = V.cells(spark, sf), normal(spark, sf).groupBy("cx", "cy").agg(F.max("zn").alias("chm"))
    n = R.rasterize(V.points(spark, sf), 1, F.count("*").alias("density"))
    return c.join(chm, R.CELL, "left").join(n, R.CELL, "left")
