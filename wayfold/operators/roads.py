"""Roads as a whole: default rows, and measuring them slice by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.scalar import road_class, road_score, slice_angle, split_count, unrotate
from wayfold.params import DEFAULTS, Parameters

from . import profiles as Q
from .checks import need_columns, need_parameters
from .conductivity import conductivity_v1
from .lines import LOOP, along, along_distances, chords, difference_index, equal_cuts, lengths, locate, measured, sinuosity
from .paths import least_cost_paths
from .points import ground_model, normalize_height, with_intensity
from .smoothing import simplified, smoothed
from .spatial import bucket

#: What a road that cannot be measured (class 0) or is none (class 4) has.
DEFAULT_ROWS = {"ROADWIDTH": (None, 0), "DRIVABLEWIDTH": (None, 0), "PERCABOVEROAD": (None, 100), "SHOULDERS": (None, 0), "SINUOSITY": (None, None), "CONDUCTIVITY": (None, 0), "SCORE": (None, 0), "CLASS": (0, 4)}


def default_rows(roads: DataFrame, none: Column) -> DataFrame:
    """roads plus the eight result columns of class 4 where `none` holds, else of class 0; columns of these names, in any case, are replaced."""
    kept = [c for c in roads.columns if c.upper() not in DEFAULT_ROWS]
    return roads.select(*kept, *(F.when(none, F.lit(b)).otherwise(F.lit(a)).cast("int" if c == "CLASS" else "double").alias(c) for c, (a, b) in DEFAULT_ROWS.items()))


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint: each step here is read by several later ones."""
    from wayfold.sources.tables import cut as write

    return write(df)


def road_differences(v: DataFrame, ref: DataFrame) -> DataFrame:
    """(line_id, area_over_perimeter, p50, p90, p100, end_max): how far lines lie from those of the same id in ref. Ids in one table only, or repeated in a table of one row a line, are the caller's to check (road_id_checks)."""
    return difference_index(ref, v).withColumnRenamed("index", "area_over_perimeter").join(along_distances(ref, v), "line_id")


def slices_of(v: DataFrame, length: float) -> DataFrame:
    """(line_id, slice_id, distance, ox, oy, dir, span): rectangles along each line between following cuts; slice_id numbers all lines' slices."""
    p = locate(v, equal_cuts(v, length)).withColumn("seq", F.col("k"))
    w = {f"n{c}": F.lead(c).over(along()) for c in ("x", "y")}
    s = p.withColumns(w).where("nx is not null")
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    return s.select("line_id", (F.col("line_id") * 1_000_000 + F.col("k")).alias("slice_id"), F.col("m").alias("distance"), ((F.col("x") + F.col("nx")) / 2).alias("ox"), ((F.col("y") + F.col("ny")) / 2).alias("oy"), slice_angle(dx, dy).alias("dir"), F.hypot(dx, dy).alias("span"))


def points_of_slices(points: DataFrame, slices: DataFrame, width: float, step: float) -> DataFrame:
    """Points in each slice's rectangle: slice_id, pos (across) and xr, its bin. Slices go to every bucket that their circle touches."""
    size = width
    r = F.hypot(F.col("span"), F.lit(float(width))) / 2
    s = slices.withColumn("gx", F.explode(F.sequence(bucket(F.col("ox") - r, size), bucket(F.col("ox") + r, size)))).withColumn("gy", F.explode(F.sequence(bucket(F.col("oy") - r, size), bucket(F.col("oy") + r, size))))
    p = points.withColumns({"gx": bucket(F.col("x"), size), "gy": bucket(F.col("y"), size)}).join(s, ["gx", "gy"])
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    p = p.withColumns({"along": dx * F.cos("dir") + dy * F.sin("dir"), "pos": dy * F.cos("dir") - dx * F.sin("dir")})
    return p.where((F.abs("along") <= F.col("span") / 2) & (F.abs("pos") <= width / 2)).withColumn("xr", F.round(F.col("pos") / step) * step).drop("gx", "gy")


def slice_metrics(points: DataFrame, slices: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """One row for each slice with points: widths, percentages, number of shoulders, and the relocated centre (x, y).

    points has zn, the height over the terrain. A slice whose edges contradict one another is left
    out (contradictory() gives those). Shares are of points below 5; zroad is the terrain in the
    middle of the road where the slice begins, from the nearest ground points.
    """
    e = p.extraction
    raw = cut(points_of_slices(points, slices, e.road_max_width, e.profile_resolution).select("slice_id", "along", "pos", "xr", "z", "zn", "cls", "intensity"))
    veg = cut(Q.vegetation_profile(raw.withColumn("z", F.col("zn"))))
    ground = cut(Q.slope_of(Q.ground_profile(raw)))
    centre = cut(Q.centreline_shift(veg))
    sh = Q.shoulders(ground, centre, p.min_slope)
    side = sh.groupBy("slice_id").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("left", "right") for c in ("start", "embankment")))
    rescue = Q.road_edges(ground, centre, p.max_sd_ground, p.max_elevation_ground).withColumnsRenamed({"left": "rl", "right": "rr"})
    edges = centre.join(side, "slice_id", "left").join(rescue, "slice_id", "left")
    edges = edges.select("slice_id", "xc", F.when(F.col("left_embankment"), F.col("left_start")).otherwise(F.col("rl")).alias("left"), F.when(F.col("right_embankment"), F.col("right_start")).otherwise(F.col("rr")).alias("right"), (F.coalesce(F.col("left_embankment").cast("int"), F.lit(0)) + F.coalesce(F.col("right_embankment").cast("int"), F.lit(0))).alias("shoulders"))
    widths = side.select("slice_id", (F.col("right_start") - F.col("left_start")).alias("accotement_width")).join(rescue.select("slice_id", (F.col("rr") - F.col("rl")).alias("rescue_width")), "slice_id", "full")
    edges = cut(edges.where("left <= right"))
    drive = cut(Q.drivable_edges(veg, edges, centre, p.max_percentage_drivable))
    over = raw.withColumn("z", F.col("zn"))
    share = Q.slice_percentages(over, edges).select("slice_id", F.col("p05").alias("pzabove05"), F.col("p2").alias("pzabove2"))
    inner = Q.drivable_percentages(over, edges, drive).select("slice_id", F.col("p05").alias("pzabove05_drive"), F.col("p2").alias("pzabove2_drive"))
    drive = drive.select("slice_id", F.round("width", 1).alias("drivable_width"))
    begin = slices.join(edges, "slice_id").select("slice_id", F.lit(0).alias("tid"), (-F.col("span") / 2).alias("tx"), F.col("xc").alias("ty"))
    zroad = Q.inverse_distance(raw, begin).select("slice_id", F.col("z").alias("zroad"))
    x, y = unrotate(F.lit(0.0), F.col("xc"), F.col("ox"), F.col("oy"), F.col("dir"))
    every = slices.join(edges, "slice_id").join(drive, "slice_id").join(share, "slice_id").join(inner, "slice_id").join(widths, "slice_id", "left").join(zroad, "slice_id", "left")
    return every.select("line_id", "slice_id", "distance", (F.col("right") - F.col("left")).alias("road_width"), "drivable_width", "accotement_width", "rescue_width", "pzabove05", "pzabove2", "pzabove05_drive", "pzabove2_drive", "shoulders", "zroad", "xc", x.alias("x"), y.alias("y"))


def contradictory(slices: DataFrame, metrics: DataFrame) -> DataFrame:
    """Slices that slice_metrics() gave no row: those without points or with edges that contradict one another, to be written apart."""
    return slices.join(metrics.select("slice_id"), "slice_id", "left_anti")


def measure_roads(points: DataFrame, v: DataFrame, p: Parameters = DEFAULTS, sigma: DataFrame | None = None, keep_class: int = 2, water: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roads, lines, errors): each line relocated (if confidence is under 1) and measured, all lines in one job.

    roads has line_id and the eight result columns; lines the new vertices, or the given ones of
    roads of a class over keep_class or unknown; errors the lines whose search failed, which are
    class 0. Lines shorter than 4 slices or without points are class 0; lines without a way, or whose
    way is shorter than 4 slices, class 4. Lines over road_max_len are cut in equal pieces, loops in two at least, and their
    means are taken over the pieces, null where one lacks the value. Line ids may be any number.
    Raises ValueError for parameters that contradict one another or tables that lack columns; a scan
    without intensity counts as 0 throughout.
    """
    need_parameters(p)
    need_columns(points, "points", "x", "y", "z", "cls")
    need_columns(v, "lines", "line_id", "seq", "x", "y")
    points = with_intensity(points)
    e = p.extraction
    size = lengths(v)
    shape = size.where(F.col("length") >= 4 * e.section_length).join(chords(v), "line_id")
    loop = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) < LOOP
    known = shape.select(F.col("line_id").alias("owner"), split_count(F.col("length"), e.road_max_len, loop).alias("pieces"))
    # pieces get numbers of their own, small enough to number their slices by; a checkpoint fixes them
    keys = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    keys = cut(keys.repartition(64, "owner").withColumn("piece", F.monotonically_increasing_id()))
    copies = v.withColumnRenamed("line_id", "owner").join(keys, "owner").select(F.col("piece").alias("line_id"), "seq", "x", "y", "k", "pieces")
    work = copies.where("pieces = 1").select("line_id", "seq", "x", "y").unionByName(substring_by(copies.where("pieces > 1")))
    of = keys.select(F.col("piece").alias("line_id"), "owner", "k")

    def owned(df: DataFrame) -> DataFrame:
        """df by line instead of by piece, with k, the piece's place in the line."""
        return df.join(of, "line_id").drop("line_id").withColumnRenamed("owner", "line_id")

    dtm = ground_model(points)
    high = normalize_height(points, dtm)
    if p.confidence < 1:
        sigma = conductivity_v1(points, dtm, p) if sigma is None else sigma
        path = cut(least_cost_paths(sigma, work, p, water=water))
        errors = owned(path.where("error is not null").select("line_id", "error")).select("line_id", "error")
        cond = path.where("error is null").groupBy("line_id").agg(F.max("conductivity").alias("conductivity"), F.count("x").alias("n"))
        route = simplified(path.where("x is not null and error is null").select("line_id", "seq", "x", "y"), 3)
        long = lengths(route).where(F.col("length") >= 4 * e.section_length).select("line_id")
        route = route.join(long, "line_id", "left_semi")
    else:
        errors = owned(work.select("line_id").limit(0)).select("line_id", F.lit(None).cast("string").alias("error"))
        cond = work.select("line_id").distinct().withColumn("conductivity", F.lit(1.0))
        route = long = work
    route = cut(route)
    slices = cut(slices_of(route, e.section_length))
    metrics = cut(slice_metrics(high, slices, p))
    line = metrics.withColumn("seq", F.row_number().over(along("distance")))
    enough = metrics.groupBy("line_id").count().where("count > 4").select("line_id")
    new = simplified(smoothed(line.join(enough, "line_id", "left_semi").select("line_id", "seq", "x", "y")), 1) if p.confidence < 1 else route
    m = Q.road_metrics(metrics.withColumn("road_id", F.col("line_id"))).withColumnRenamed("road_id", "line_id").join(sinuosity(new).withColumnRenamed("sinuosity", "SINUOSITY"), "line_id", "left").join(cond.select("line_id", F.col("conductivity").alias("CONDUCTIVITY")), "line_id", "left")
    names = ["ROADWIDTH", "DRIVABLEWIDTH", "PERCABOVEROAD", "SHOULDERS", "SINUOSITY", "CONDUCTIVITY"]
    # a value that one piece lacks is lacking for the line
    m = owned(m).groupBy("line_id").agg(*(F.round(F.when(F.count(c) == F.count("*"), F.avg(c)), 2 if c in ("SINUOSITY", "CONDUCTIVITY") else 1).alias(c) for c in names))
    m = m.withColumn("SCORE", road_score(*(F.col(c) for c in ("PERCABOVEROAD", "DRIVABLEWIDTH", "CONDUCTIVITY", "SHOULDERS")), p)).withColumn("CLASS", road_class(F.col("SCORE")))
    short = cond.where("conductivity > 0").join(long, "line_id", "left_anti")
    lost = owned(cond.where("conductivity = 0").unionByName(short, allowMissingColumns=True).select("line_id")).select("line_id").distinct()
    rest = size.select("line_id").join(m.select("line_id"), "line_id", "left_anti").join(lost.withColumn("none", F.lit(True)), "line_id", "left")
    m = cut(m)
    roads = m.unionByName(default_rows(rest, F.coalesce("none", F.lit(False))).drop("none"))
    good = roads.where(F.col("CLASS").between(1, keep_class)).select("line_id")
    moved = owned(new).join(good, "line_id", "left_semi")
    moved = moved.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("k", "seq")).cast("bigint").alias("seq"), "x", "y")
    kept = v.select("line_id", "seq", "x", "y").join(moved.select("line_id").distinct(), "line_id", "left_anti")
    return roads, moved.unionByName(kept), errors


def substring_by(copies: DataFrame) -> DataFrame:
    """Piece k of `pieces` equal ones of each copy of a line, as a line of its own."""
    ends = copies.select("line_id", "k", "pieces").distinct()
    v = copies.select("line_id", "seq", "x", "y")
    size = lengths(v).join(ends, "line_id")
    share = size.select("line_id", (F.col("length") * F.col("k") / F.col("pieces")).alias("lo"), F.least(F.col("length") * (F.col("k") + 1) / F.col("pieces"), F.col("length")).alias("hi"))
    at = share.select("line_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("lo").alias("m")), F.struct(F.lit(1).alias("k"), F.col("hi").alias("m")))).alias("c")).select("line_id", "c.k", "c.m")
    inner = measured(v).join(share, "line_id").where("m > lo and m < hi").select("line_id", "m", "x", "y")
    out = inner.union(locate(v, at).select("line_id", "m", "x", "y"))
    return out.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("m", "x", "y")).cast("bigint").alias("seq"), "x", "y")
