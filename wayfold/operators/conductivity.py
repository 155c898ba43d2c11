"""Conductivity of the ground for roads: two models, from points to a grid of 2 x 2 unit cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.scalar import activation_linear, activation_steps, sigma_v1, sigma_v2
from wayfold.params import DEFAULTS, DEFAULTS_V2, Parameters

from . import points as P
from . import raster as R
from .kernels import diffused
from .raster import CELL


def terrain_bands(dtm: DataFrame) -> DataFrame:
    """(cx, cy, slope, roughness, sobel) of a terrain (cx, cy, dtm)."""
    z = dtm.select(*CELL, F.col("dtm").alias("v"))
    slope = R.slope(z)
    smooth = R.focal_mean(z, 5, whole=True).withColumnRenamed("v", "s")
    rough = R.roughness(z.join(smooth, CELL).select(*CELL, (F.col("v") - F.col("s")).alias("v")))
    edge = R.sobel(slope)
    return slope.withColumnRenamed("v", "slope").join(rough.withColumnRenamed("v", "roughness"), CELL, "left").join(edge.withColumnRenamed("v", "sobel"), CELL, "left")


def conductivity_v1(points: DataFrame, dtm: DataFrame | None = None, p: Parameters = DEFAULTS, use_intensity: bool = True, bands: bool = False, aggregate: bool = True) -> DataFrame:
    """(cx, cy, sigma), with `bands` also what it is made of, over the cells of the terrain; blocks of 2 x 2 unless aggregate is false.

    Thresholds of intensity and density are quantiles over all cells given, so a caller that works
    by tiles chooses their scope. Where the terrain's window lacks a cell sigma is null, and the
    blocks' means leave it out.
    """
    c = p.conductivity
    dtm = P.ground_model(points) if dtm is None else dtm
    n = P.normalize_height(points, dtm)
    if use_intensity:
        n = P.cap_outliers(P.correct_intensity(n))
    low = F.count_if((F.col("zn") > 0.5) & (F.col("zn") < 3))
    cell = n.groupBy(*CELL).agg(F.max("zn").alias("chm"), low.alias("low"), (F.max("intensity") - F.min("intensity")).alias("irange"), F.count_if(F.col("cls") == P.GROUND).cast("double").alias("d0"))
    density = R.focal_mean(cell.select(*CELL, F.col("d0").alias("v")), 3, whole=False, centre=2).withColumnRenamed("v", "density")
    all_bands = dtm.select(*CELL).join(terrain_bands(dtm), CELL, "left").join(cell.drop("d0"), CELL, "left").join(density, CELL, "left")
    th = all_bands.agg(F.percentile("irange", list(c.q)).alias("qi"), F.percentile(F.when(F.col("density") > 0, F.round("density", 9)), list(c.d)).alias("qd"))
    s = all_bands.crossJoin(F.broadcast(th)).withColumns(
        {
            "sigma_slope": activation_linear(F.col("slope"), *c.s, rising=False),
            "sigma_roughness": activation_linear(F.round("roughness", 9), *c.r, rising=False),
            "sigma_edge": activation_steps(F.round("sobel", 9), c.e, rising=False),
            "sigma_intensity": activation_linear(F.col("irange"), F.get("qi", 0), F.get("qi", 1), rising=False) if use_intensity else F.lit(0.0),
            "sigma_chm": activation_linear(F.col("chm"), *c.h, rising=False),
            "sigma_low": activation_steps(F.coalesce("low", F.lit(0)), (2,), rising=False),
            "sigma_density": activation_linear(F.round("density", 9), F.get("qd", 0), F.get("qd", 1)),
        }
    ).drop("qi", "qd")
    s = s.withColumn("sigma", sigma_v1(*(F.col(f"sigma_{k}") for k in ("slope", "low", "edge", "density", "chm", "roughness", "intensity")), p, use_intensity))
    if not bands:
        s = s.select(*CELL, "sigma")
    if not aggregate:
        return s
    return s.withColumns({k: F.floor(F.col(k) / 2).cast("int") for k in CELL}).groupBy(*CELL).agg(*(F.avg(k).alias(k) for k in s.columns if k not in CELL))


def edge_enhanced(cells: DataFrame, tile: int = 256, halo: int = 32, value: str = "v", upper: float = 0.995) -> DataFrame:
    """cells with values diffused tile by tile, then stretched by the least and the upper quantile (to 1 in 10,000 ranks) of all cells.

    Each tile's group also gets the cells within the halo, which are dropped after. Two tilings
    differ only by what reaches a cell from beyond the halo.
    """
    from wayfold.sources.tables import cut

    near = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    t = cells.select(*CELL, F.col(value).cast("double").alias("v")).withColumn("o", near)
    t = t.withColumns({"tx": F.floor(F.col("cx") / tile).cast("int") + F.col("o.dx"), "ty": F.floor(F.col("cy") / tile).cast("int") + F.col("o.dy")}).drop("o")
    inside = F.col("cx").between(F.col("tx") * tile - halo, (F.col("tx") + 1) * tile + halo - 1) & F.col("cy").between(F.col("ty") * tile - halo, (F.col("ty") + 1) * tile + halo - 1)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf.cx.min(), pdf.cy.min()
        a = np.full((pdf.cy.max() - y0 + 1, pdf.cx.max() - x0 + 1), np.nan)
        a[pdf.cy - y0, pdf.cx - x0] = pdf.v
        out = diffused(a)
        own = pdf[(pdf.cx // tile == key[0]) & (pdf.cy // tile == key[1])]
        return pd.DataFrame({"cx": own.cx, "cy": own.cy, value: out[own.cy - y0, own.cx - x0]})

    out = cut(t.where(inside).groupBy("tx", "ty").applyInPandas(run, f"cx int, cy int, {value} double"))
    ends = out.agg(F.min(value).alias("_lo"), F.percentile_approx(value, upper, 10_000).alias("_hi"))
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return out.crossJoin(F.broadcast(ends)).select(*CELL, F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)).alias(value))


def conductivity_v2(points: DataFrame, dtm: DataFrame | None = None, water: DataFrame | None = None, p: Parameters = DEFAULTS_V2, use_intensity: bool = True, raw: bool = False) -> DataFrame:
    """(cx, cy, sigma) in cells of 2 x 2: graded edges and bands by flightline, edge-enhanced, with steep ground, unknown ground and bridges set after.

    water: (gid, x1, y1, x2, y2) edges of polygons, whose points count as water, and as bridge when
    over 2 high. raw gives the bands instead.
    """
    from .spatial import in_polygons

    c = p.conductivity
    dtm = P.ground_model(points) if dtm is None else dtm
    n = P.normalize_height(points, dtm)
    wet2 = None
    if water is not None:
        places = n.select(F.struct("x", "y").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
        wet = in_polygons(places, water).select("pid.x", "pid.y", F.lit(True).alias("wet")).distinct()
        n = n.join(wet, ["x", "y"], "left").withColumn("cls", F.when(F.col("wet") & (F.col("zn") > 2), P.BRIDGE).when(F.col("wet"), P.WATER).otherwise(F.col("cls")))
        centres = dtm.select(F.struct("cx", "cy").alias("pid"), (F.col("cx") + 0.5).cast("double").alias("px"), (F.col("cy") + 0.5).cast("double").alias("py"))
        wet2 = in_polygons(centres, water).select("pid.cx", "pid.cy", F.lit(True).alias("masked")).distinct()
    bands = dtm.select(*CELL).join(terrain_bands(dtm), CELL, "left").join(n.groupBy(*CELL).agg(F.max("zn").alias("chm")), CELL, "left")
    if wet2 is not None:
        bands = bands.join(wet2, CELL, "left").withColumns({k: F.when(F.col("masked").isNull(), F.col(k)) for k in ("slope", "sobel")}).drop("masked")
    two = {k: F.floor(F.col(k) / 2).cast("int") for k in CELL}
    fine = bands.withColumns({"e": activation_linear(F.col("sobel"), *c.e, rising=False), "r": activation_linear(F.col("roughness"), *c.r, rising=False), "h": activation_linear(F.col("chm"), *c.h, rising=False), "steep": (~(F.col("slope") < 25)).cast("int")})
    coarse = fine.withColumns(two).groupBy(*CELL).agg(*(F.avg(k).alias(k) for k in ("e", "r", "h", "slope", "roughness", "chm", "sobel")), F.max("steep").alias("steep"))
    lows = R.by_flightline(P.low_points(n), 2, F.count("*").cast("double"), "cell").withColumnRenamed("v", "low")
    d = R.by_flightline(P.trim_angles(n.where(F.col("cls") == P.GROUND), 0), 2, F.count("*") / 4.0, "cell")
    d = R.focal_mean(d, 3, whole=False).withColumnRenamed("v", "density")
    joined = coarse.join(lows, CELL, "left").join(d, CELL, "left")
    if use_intensity:
        joined = joined.join(R.by_flightline(n, 2, F.max("intensity") - F.min("intensity"), "intensity").withColumnRenamed("v", "irange"), CELL, "left")
    else:
        joined = joined.withColumn("irange", F.lit(None).cast("double"))
    if raw:
        return joined.select(*CELL, "slope", "roughness", "chm", F.col("irange").alias("intensity"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("density", F.lit(0.0)).alias("density"), "sobel")
    i = activation_linear(F.col("irange"), 0.25, 0.35, rising=False) if use_intensity else F.lit(0.0)
    sigma = sigma_v2(F.col("e"), activation_linear(F.coalesce("density", F.lit(0.0)), 0.33, 0.66), F.col("h"), F.col("r"), i, p, use_intensity)
    enhanced = edge_enhanced(joined.select(*CELL, sigma.alias("v"))).withColumnRenamed("v", "enhanced")
    out = joined.select(*CELL, sigma.alias("known"), "steep").join(enhanced, CELL)
    bridge = n.where(F.col("cls") == P.BRIDGE).withColumns(two).select(*CELL, F.lit(True).alias("bridge")).distinct()
    final = F.when(F.col("bridge"), 0.75).when(F.col("known").isNull() | F.col("enhanced").isNull() | (F.col("enhanced") < 0.1) | (F.col("steep") == 1), 0.1).otherwise(F.col("enhanced"))
    return out.join(bridge, CELL, "left").select(*CELL, final.alias("sigma"))
