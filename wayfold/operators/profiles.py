"""Ordered series and cross-road profiles, by windows in each series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: Iterable[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def interpolate(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Fills nulls between two values on a straight line over row numbers; those before the first and after the last stay."""
    w = _w(keys, order)
    known = F.col(value).isNotNull()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w))
    df = df.withColumns({"_y0": F.last(value, ignorenulls=True).over(before), "_y1": F.first(value, ignorenulls=True).over(after), "_i0": F.max(F.when(known, F.col("_i"))).over(before), "_i1": F.min(F.when(known, F.col("_i"))).over(after)})
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.try_divide(F.col("_i") - F.col("_i0"), F.col("_i1") - F.col("_i0"))
    return df.withColumn(out, F.when(known, F.col(value)).otherwise(line)).drop("_i", "_y0", "_y1", "_i0", "_i1")


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, n: int, out: str) -> DataFrame:
    """Centred mean of n rows (an even n leans ahead) after interpolate(); null where a row lacks."""
    df = interpolate(df, keys, order, value, "_f")
    w = _w(keys, order).rowsBetween(-((n - 1) // 2), n // 2)
    return df.withColumn(out, F.when(F.count("_f").over(w) == n, F.avg("_f").over(w))).drop("_f")


def derivative(keys: list[str], order: str, x: str, y: str) -> Column:
    """Central differences, one-sided at the ends."""
    w = _w(keys, order)
    dx = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    dy = F.when(F.lead(x).over(w).isNull(), F.col(y)).otherwise(F.lead(y).over(w)) - F.when(F.lag(x).over(w).isNull(), F.col(y)).otherwise(F.lag(y).over(w))
    return F.try_divide(dy, dx)


def ground_profile(points: DataFrame) -> DataFrame:
    """(slice_id, xr, n, avg_z, sd_z, ssd_z): ground and water points by position across; ssd_z is the moving average of sd_z."""
    g = points.where(F.col("cls").isin(2, 9)).groupBy("slice_id", "xr").agg(F.count("*").alias("n"), F.avg("z").alias("avg_z"), F.stddev_samp("z").alias("sd_z"))
    return moving_average(g, ["slice_id"], "xr", "sd_z", 3, "ssd_z")


def vegetation_profile(points: DataFrame) -> DataFrame:
    """Counts by position across, the shares of points over three heights below 5, smoothed, and the intensity range."""
    z = F.col("z")
    low = F.count_if(z < 5)
    g = points.groupBy("slice_id", "xr").agg(
        F.count_if(F.col("cls") == 2).alias("ngnd"),
        *(F.count_if((z >= h) & (z < 5)).alias(f"n{k}") for k, h in (("2", 2.0), ("05", 0.5), ("01", 0.1))),
        F.count("*").alias("npoint"),
        low.alias("nlow"),
        (F.max("intensity") - F.min("intensity")).alias("cvi"),
        F.stddev_samp("z").alias("sd_z"),
    )
    for k in ("2", "05", "01"):
        g = moving_average(g.withColumn("_p", F.coalesce(F.try_divide(F.col(f"n{k}"), F.col("nlow")), F.lit(0.0))), ["slice_id"], "xr", "_p", 3, f"pabove{k}").drop("_p")
    return g


def slice_percentages(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(slice_id, p05, p2, pground): percentages of the points strictly between each slice's edges; 0, 100 and null where there are none."""
    z = F.col("z")
    inside = points.join(edges, "slice_id").where((F.col("pos") > F.col("left")) & (F.col("pos") < F.col("right")))
    low = F.count_if(z < 5)
    got = inside.groupBy("slice_id").agg(
        F.round(F.try_divide(100 * F.count_if((z > 0.5) & (z < 5)), low), 1).alias("p05"),
        F.round(F.try_divide(100 * F.count_if((z > 2) & (z < 5)), low), 1).alias("p2"),
        F.round(100 * F.count_if(F.col("cls") == 2) / F.count("*"), 1).alias("pground"),
    )
    return edges.select("slice_id").join(got.withColumn("some", F.lit(1)), "slice_id", "left").select("slice_id", F.when(F.col("some").isNull(), 0.0).otherwise(F.col("p05")).alias("p05"), F.when(F.col("some").isNull(), 100.0).otherwise(F.col("p2")).alias("p2"), "pground")


def drivable_percentages(points: DataFrame, edges: DataFrame, drive: DataFrame) -> DataFrame:
    """slice_percentages() between the drivable edges too, which need not lie inside the road's: null without points there, but 0, 100 and null where the road itself has none."""
    z = F.col("z")
    both = edges.select("slice_id", "left", "right").join(drive.select("slice_id", F.col("left").alias("dl"), F.col("right").alias("dr")), "slice_id", "left")
    road = points.join(both, "slice_id").where((F.col("pos") > F.col("left")) & (F.col("pos") < F.col("right")))
    on = F.coalesce((F.col("pos") > F.col("dl")) & (F.col("pos") < F.col("dr")), F.lit(False))
    low = F.count_if(on & (z < 5))
    got = road.groupBy("slice_id").agg(
        F.round(F.try_divide(100 * F.count_if(on & (z > 0.5) & (z < 5)), low), 1).alias("p05"),
        F.round(F.try_divide(100 * F.count_if(on & (z > 2) & (z < 5)), low), 1).alias("p2"),
        F.round(F.try_divide(100 * F.count_if(on & (F.col("cls") == 2)), F.count_if(on)), 1).alias("pground"),
    )
    return edges.select("slice_id").join(got.withColumn("some", F.lit(1)), "slice_id", "left").select("slice_id", F.when(F.col("some").isNull(), 0.0).otherwise(F.col("p05")).alias("p05"), F.when(F.col("some").isNull(), 100.0).otherwise(F.col("p2")).alias("p2"), "pground")


def inverse_distance(points: DataFrame, at: DataFrame, k: int = 10, power: float = 2) -> DataFrame:
    """(slice_id, tid, z): at places (slice_id, tid, tx, ty), the mean height of the slice's k nearest ground points (along, pos, z) by distance to the -power; a point at the place itself decides alone.

    A place meets its own slice's points only; equal distances go by height.
    """
    g = points.where(F.col("cls").isin(2, 9)).select("slice_id", "along", "pos", "z").join(at, "slice_id")
    g = g.withColumn("d", F.hypot(F.col("along") - F.col("tx"), F.col("pos") - F.col("ty")))
    g = g.withColumn("_r", F.row_number().over(Window.partitionBy("slice_id", "tid").orderBy("d", "z"))).where(F.col("_r") <= k)
    w = F.when(F.col("d") > 0, F.pow("d", F.lit(-float(power))))
    return g.groupBy("slice_id", "tid").agg(F.coalesce(F.avg(F.when(F.col("d") == 0, F.col("z"))), F.sum(w * F.col("z")) / F.sum(w)).alias("z"))


def outward(profile: DataFrame, centre: DataFrame, keys: list[str]) -> DataFrame:
    """Profile rows twice labelled by side ("left" at or before the centre, "right" at or after it) with k, the rank outward from it."""
    j = profile.join(centre, keys)
    both = j.where(F.col("xr") <= F.col("xc")).withColumn("side", F.lit("left")).union(j.where(F.col("xr") >= F.col("xc")).withColumn("side", F.lit("right")))
    return both.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(F.abs(F.col("xr") - F.col("xc")), "xr")))


def first_outward(side_rows: DataFrame, keys: list[str], stop: Column, out: str) -> DataFrame:
    """(keys, side, out): xr of the first row outward where stop holds (or is unknown), else of the last."""
    hit = F.coalesce(stop, F.lit(True))
    return side_rows.groupBy(*keys, "side").agg(F.coalesce(F.min_by("xr", F.when(hit, F.col("k"))), F.max_by("xr", "k")).alias(out))


def slope_of(profile: DataFrame, value: str = "avg_z") -> DataFrame:
    """Adds slope, in degrees to 2 decimals, of a profile."""
    return profile.withColumn("slope", F.round(F.abs(F.degrees(F.atan(derivative(["slice_id"], "xr", "xr", value)))), 2))


def shoulder_centre(profile: DataFrame, centre: DataFrame) -> DataFrame:
    """(slice_id, xc): where the smoothed slope is least within 2 of the given centre, if over 2 rows are there; else as given."""
    s = moving_average(profile, ["slice_id"], "xr", "slope", 3, "ms").join(centre, "slice_id").where(F.col("xr").between(F.col("xc") - 2, F.col("xc") + 2))
    moved = s.groupBy("slice_id").agg(F.when(F.count("*") > 2, F.min_by("xr", F.when(F.col("ms").isNotNull(), F.struct(F.round("ms", 6), "xr")))).alias("moved"))
    return centre.join(moved, "slice_id", "left").select("slice_id", F.coalesce("moved", "xc").alias("xc"))


def shoulders(profile: DataFrame, centre: DataFrame, th_slope: float = 10, embankment_slope: float = 10) -> DataFrame:
    """(slice_id, side, start, end, dz, slope, width, embankment): going outward, the first slope of th_slope or more, and the first of th_slope or less from there on.

    Without a start both are the last place; without an end it is the start. An embankment is at
    least 1 wide and embankment_slope steep.
    """
    o = outward(profile.select("slice_id", "xr", "avg_z", "slope"), shoulder_centre(profile, centre), ["slice_id"])
    w = Window.partitionBy("slice_id", "side")
    steep, mild = F.col("slope") >= th_slope, F.col("slope") <= th_slope
    o = o.withColumn("first", F.min(F.when(steep, F.col("k"))).over(w)).withColumn("last", F.max("k").over(w))
    o = o.withColumn("s", F.coalesce("first", "last")).withColumn("e", F.coalesce(F.min(F.when(mild & (F.col("k") >= F.col("first")), F.col("k"))).over(w), F.col("s")))
    at_s, at_e = F.col("k") == F.col("s"), F.col("k") == F.col("e")
    g = o.groupBy("slice_id", "side").agg(*(F.max(F.when(c, F.col(v))).alias(n) for n, c, v in (("start", at_s, "xr"), ("end", at_e, "xr"), ("z0", at_s, "avg_z"), ("z1", at_e, "avg_z"))))
    dz, width = F.col("z1") - F.col("z0"), F.abs(F.col("end") - F.col("start"))
    g = g.withColumns({"dz": dz, "width": width}).withColumn("slope", F.coalesce(F.round(F.degrees(F.atan(F.try_divide(F.abs("dz"), F.col("width")))), 2), F.lit(0.0)))
    return g.select("slice_id", "side", "start", "end", "dz", "slope", "width", ((F.col("width") >= 1) & (F.col("slope") >= embankment_slope)).alias("embankment"))


def road_edges(profile: DataFrame, centre: DataFrame, thsd: float, thz: float) -> DataFrame:
    """(slice_id, left, right): outward from the centre to where the smoothed sd is over thsd, or the smoothed height off the centre's over thz, or either unknown."""
    p = moving_average(profile, ["slice_id"], "xr", "avg_z", 3, "mz")
    zero = p.join(centre, "slice_id").groupBy("slice_id").agg(F.min_by("mz", F.when(F.col("mz").isNotNull(), F.struct(F.abs(F.col("xr") - F.col("xc")), "xr"))).alias("z0"))
    o = outward(p, centre, ["slice_id"]).join(zero, "slice_id")
    e = first_outward(o, ["slice_id"], (F.col("ssd_z") > thsd) | (F.abs(F.col("mz") - F.col("z0")) > thz), "edge")
    return centre.select("slice_id").join(e.groupBy("slice_id").agg(*(F.max(F.when(F.col("side") == s, F.col("edge"))).alias(s) for s in ("left", "right"))), "slice_id", "left")


def drivable_edges(veg: DataFrame, edges: DataFrame, centre: DataFrame, th: float = 0.15) -> DataFrame:
    """(slice_id, left, right, width): outward within the road's edges to where more than th of the low points are over 0.5; width 0 for less than two rows."""
    p = veg.join(edges.select("slice_id", F.col("left").alias("l"), F.col("right").alias("r")), "slice_id").where(F.col("xr").between(F.col("l"), F.col("r")))
    o = outward(p.select("slice_id", "xr", "pabove05"), centre, ["slice_id"])
    e = first_outward(o, ["slice_id"], F.coalesce(F.col("pabove05") > th, F.lit(False)), "edge").groupBy("slice_id").agg(*(F.max(F.when(F.col("side") == s, F.col("edge"))).alias(s) for s in ("left", "right")))
    many = p.groupBy("slice_id").agg((F.count("*") > 1).alias("many"))
    return edges.select("slice_id").join(e, "slice_id", "left").join(many, "slice_id", "left").select("slice_id", "left", "right", F.when(F.col("many"), F.coalesce(F.col("right") - F.col("left"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("width"))


def quadratic(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, mean, c0, c1, c2): least squares of y on x - mean and its square, from sums; null for fewer than three places."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_m", F.avg(x).over(Window.partitionBy(key))).withColumn("_u", F.col(x) - F.col("_m"))
    u, v = F.col("_u"), F.col(y)
    s = d.groupBy(key).agg(F.first("_m").alias("mean"), F.count("*").alias("n"), F.sum(u).alias("s1"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(v).alias("t0"), F.sum(u * v).alias("t1"), F.sum(u * u * v).alias("t2"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c, d_, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d_ * i - f * g) + c * (d_ * h - e * g)

    den = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    fine = F.when(F.abs(den) > 1e-6, den)
    c0, c1, c2 = det(t0, s1, s2, t1, s2, s3, t2, s3, s4), det(n, t0, s2, s1, t1, s3, s2, t2, s4), det(n, s1, t0, s1, s2, t1, s2, s3, t2)
    return s.select(key, "mean", (c0 / fine).alias("c0"), (c1 / fine).alias("c1"), (c2 / fine).alias("c2"))


def centreline_shift(veg: DataFrame) -> DataFrame:
    """(slice_id, xc): the lowest place of a parabola through a score of roughness, lack of ground and intensity range within 7 of the middle.

    The three are moving averages of 12 places by their greatest. Taken if the parabola opens
    upward and its foot is less than 5 away, and kept within the profile; else 0.
    """
    p = veg
    for c, out in (("sd_z", "m1"), ("ngnd", "m2"), ("cvi", "m3")):
        p = moving_average(p, ["slice_id"], "xr", c, 12, out)
    p = p.where(F.col("xr").between(-7, 7))
    w = Window.partitionBy("slice_id")

    def share(c: str) -> Column:
        return F.try_divide(F.col(c), F.max(c).over(w))

    p = p.withColumns({"a": share("m1"), "b": share("m2"), "c": share("m3")})
    p = p.withColumn("score", F.col("a") + 2 * (1 - (F.col("b") - F.min("b").over(w))) + F.col("c"))
    fit = quadratic(p, "slice_id", "xr", "score")
    ends = p.groupBy("slice_id").agg(F.count("score").alias("n"), F.min("xr").alias("lo"), F.max("xr").alias("hi"))
    foot = F.col("mean") - F.try_divide(F.col("c1"), 2 * F.col("c2"))
    good = (F.col("n") > 3) & (F.col("c2") > 1e-9) & (F.abs(foot) < 5)
    return ends.join(fit, "slice_id", "left").select("slice_id", F.when(good, F.least(F.greatest(foot, F.col("lo")), F.col("hi"))).otherwise(F.lit(0.0)).alias("xc"))


def road_metrics(slices: DataFrame, strict: bool = False) -> DataFrame:
    """Means of slice metrics by road, to 1 decimal; SHOULDERS is the percentage of two. With strict, a missing metric makes the mean null."""
    def mean(c: str) -> Column:
        return F.when(F.count(c) == F.count("*"), F.avg(c)) if strict else F.avg(c)

    return slices.groupBy("road_id").agg(
        # to 9 decimals first, lest the order of summing turns a tie
        F.round(F.round(mean("road_width"), 9), 1).alias("ROADWIDTH"),
        F.round(F.round(mean("drivable_width"), 9), 1).alias("DRIVABLEWIDTH"),
        F.round(F.round(mean("pzabove05"), 9), 1).alias("PERCABOVEROAD"),
        F.round(F.round(mean("shoulders") / 2 * 100, 9), 1).alias("SHOULDERS"),
    )
