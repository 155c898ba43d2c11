"""Point-cloud operators: heights, intensity correction, caps, filters and flightline offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import CELL, rasterize, to_cells

GROUND, WATER, BRIDGE = 2, 9, 17


def with_intensity(points: DataFrame) -> DataFrame:
    """points with an intensity of 0 where the scan has no such column."""
    return points if "intensity" in points.columns else points.withColumn("intensity", F.lit(0))


def ground_model(points: DataFrame, res: float = 1) -> DataFrame:
    """A terrain from ground points: the least z of each cell that has some."""
    return rasterize(points.where(F.col("cls") == GROUND), res, F.min("z").alias("dtm"))


def normalize_height(points: DataFrame, dtm: DataFrame, res: float = 1) -> DataFrame:
    """points plus cx, cy, dtm and zn, the height over the cell's terrain; points off the terrain are dropped."""
    return to_cells(points, res).join(dtm, CELL).withColumn("zn", F.round(F.col("z") - F.col("dtm"), 6))


def flightline_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("psid").agg(F.count("*").alias("n"), F.min("intensity").alias("imin"), F.percentile("intensity", 0.5).alias("med"), F.stddev_samp("intensity").alias("sd"))


def flightline_factors(points: DataFrame) -> DataFrame:
    """(psid, n, med, factor): a line's median intensity by that of the line of most points (the first of equal ones); 0 counts as 1."""
    u = flightline_summary(points)
    ref = u.agg(F.min_by("med", F.struct(-F.col("n"), F.col("psid"))).alias("ref"))
    f = F.try_divide("med", "ref")
    return u.crossJoin(F.broadcast(ref)).select("psid", "n", "med", F.when(f == 0, 1.0).otherwise(f).alias("factor"))


def correct_intensity(points: DataFrame) -> DataFrame:
    """Intensity brought to that of the reference flightline and cut to a whole number."""
    f = flightline_factors(points).select("psid", "factor")
    return points.join(F.broadcast(f), "psid").withColumn("intensity", F.col("intensity").cast("double") / F.col("factor")).withColumn("intensity", F.col("intensity").cast("int")).drop("factor")


def z_score(points: DataFrame) -> DataFrame:
    """points plus zs, the intensity's distance from its flightline's mean in standard deviations, 0 where there is none; a row a flightline is broadcast."""
    line = points.groupBy("psid").agg(F.avg("intensity").alias("_mean"), F.stddev_samp("intensity").alias("_sd"))
    line = line.withColumnRenamed("psid", "_psid")
    return points.join(F.broadcast(line), F.col("psid").eqNullSafe(F.col("_psid"))).drop("_psid").withColumn("zs", F.coalesce(F.try_divide(F.col("intensity") - F.col("_mean"), F.col("_sd")), F.lit(0.0))).drop("_mean", "_sd")


def cap_outliers(points: DataFrame, times: int = 2, q: float = 0.98) -> DataFrame:
    """Intensity no greater than `times` the whole part of its quantile; adds that as cap."""
    cap = points.agg((F.percentile("intensity", q).cast("int") * times).alias("cap"))
    return points.crossJoin(F.broadcast(cap)).withColumn("intensity", F.least("intensity", "cap"))


def trim_angles(points: DataFrame, drop: float) -> DataFrame:
    """Points whose scan angle is less than the greatest by over drop; with drop 0 all stay."""
    top = points.agg(F.max(F.abs("angle")).alias("_top"))
    joined = points.crossJoin(F.broadcast(top))
    keep = F.abs("angle") <= F.col("_top") if drop == 0 else F.abs("angle") < F.col("_top") - drop
    return joined.where(keep).drop("_top")


def low_points(points: DataFrame, z: str = "zn") -> DataFrame:
    return points.where((F.col(z) > 0.5) & (F.col(z) < 3))


def flightline_offsets(points: DataFrame, res: float = 5) -> DataFrame:
    """(i, j, offset, n): for each two flightlines that share cells, the mean difference of their least z there, and the number of cells."""
    low = rasterize(points, res, F.min("z").alias("z"), by=["psid"])
    a = low.select(*CELL, F.col("psid").alias("i"), F.col("z").alias("zi"))
    b = low.select(*CELL, F.col("psid").alias("j"), F.col("z").alias("zj"))
    return a.join(b, CELL).where("i <> j").groupBy("i", "j").agg(F.round(F.round(F.avg(F.col("zi") - F.col("zj")), 9), 3).alias("offset"), F.count("*").alias("n"))


def fill_offsets(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """(i, j, offset, n) of pairs without common cells: over all simple paths of two or three measured steps, offsets summed, weighted by the mean support of their steps."""
    step = offsets.select("i", "j", "offset", "n")

    def then(paths: DataFrame, k: int) -> DataFrame:
        nxt = step.select(F.col("i").alias(f"p{k}"), F.col("j").alias(f"p{k + 1}"), F.col("offset").alias("o2"), F.col("n").alias("n2"))
        seen = [F.col(f"p{m}") != F.col(f"p{k + 1}") for m in range(k + 1)]
        cond = seen[0]
        for s in seen[1:]:
            cond = cond & s
        return paths.join(nxt, f"p{k}").where(cond).withColumns({"o": F.col("o") + F.col("o2"), "n": F.col("n") + F.col("n2")}).drop("o2", "n2")

    one = step.select(F.col("i").alias("p0"), F.col("j").alias("p1"), F.col("offset").alias("o"), F.col("n"))
    two = then(one, 1)
    three = then(two, 2)
    ends = two.select(F.col("p0").alias("i"), F.col("p2").alias("j"), "o", (F.col("n") / 2).alias("w")).union(three.select("p0", "p3", "o", F.col("n") / 3))
    known = step.select("i", "j")
    return ends.join(known, ["i", "j"], "left_anti").groupBy("i", "j").agg(F.round(F.round(F.sum(F.col("o") * F.col("w")) / F.sum("w"), 9), 3).alias("offset"), F.round(F.avg("w"), 6).alias("n"))


def realign_heights(points: DataFrame, offsets: DataFrame, scale: float = 0.01) -> DataFrame:
    """z less each flightline's offset from the line whose offsets are least in all (the first of equal ones), in whole scale steps."""
    lines = points.select("psid").distinct()
    n = lines.agg((F.count("*") - 1).alias("_n"))
    total = offsets.groupBy("i").agg(F.sum(F.abs("offset")).alias("s"), F.count("*").alias("k")).crossJoin(F.broadcast(n))
    ref = total.agg(F.min_by("i", F.struct((F.col("k") < F.col("_n")).cast("int"), F.round("s", 6), "i")).alias("ref"))
    shift = offsets.crossJoin(F.broadcast(ref)).where("j = ref").select(F.col("i").alias("psid"), F.col("offset").alias("shift"))
    return points.join(F.broadcast(shift), "psid", "left").withColumn("z", F.round((F.col("z") - F.coalesce("shift", F.lit(0.0))) / scale) * scale).drop("shift")


def in_oriented_rectangle(points: DataFrame, cx: Column, cy: Column, angle: Column, length: float, width: float) -> Column:
    """Whether a point lies in a rectangle of `length` along `angle` and `width` across it."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return (F.abs(dx * F.cos(angle) + dy * F.sin(angle)) <= length / 2) & (F.abs(dy * F.cos(angle) - dx * F.sin(angle)) <= width / 2)


def flightlines_by_gap(pulses: DataFrame, time: str, gap: float, by: str, tie: str) -> DataFrame:
    """Numbers the runs of pulses of each `by` whose times are no more than gap apart: adds line. Equal times go by `tie`."""
    w = Window.partitionBy(by).orderBy(time, tie)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return pulses.withColumn("_new", new).withColumn("line", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")
