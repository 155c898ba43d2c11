"""Least-cost paths of roads over a conductivity grid: masking, end caps, and one search for each road."""

from __future__ import annotations

from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.scalar import buffer_near_closed
from wayfold.params import DEFAULTS, Parameters

from .kernels import least_cost
from .lines import LOOP, chords, locate, segments
from .raster import CELL
from .spatial import bucket, in_polygons


def near_cells(cells: DataFrame, v: DataFrame, reach: float, res: float) -> DataFrame:
    """(line_id, cx, cy, sigma, d): each line's cells whose centre is within reach of it, and how far."""
    s = segments(v).select("line_id", "x1", "y1", "x2", "y2")
    s = s.withColumn("gx", F.explode(F.sequence(bucket(F.least("x1", "x2") - reach, reach), bucket(F.greatest("x1", "x2") + reach, reach)))).withColumn("gy", F.explode(F.sequence(bucket(F.least("y1", "y2") - reach, reach), bucket(F.greatest("y1", "y2") + reach, reach))))
    c = cells.select(*CELL, "sigma").withColumns({"px": (F.col("cx") + 0.5) * res, "py": (F.col("cy") + 0.5) * res})
    c = c.withColumns({"gx": bucket(F.col("px"), reach), "gy": bucket(F.col("py"), reach)})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d = F.hypot(F.col("px") - F.col("x1") - t * dx, F.col("py") - F.col("y1") - t * dy)
    return c.join(s, ["gx", "gy"]).groupBy("line_id", *CELL, "sigma", "px", "py").agg(F.min(d).alias("d")).where(F.col("d") <= reach)


def end_chords(v: DataFrame, length: float = 20) -> DataFrame:
    """(line_id, ax, ay, aux, auy, bx, by, bux, buy): both ends of lines and the unit directions inward, to the point `length` on (or the other end)."""
    from .lines import lengths

    size = lengths(v).withColumn("m", F.least(F.lit(float(length)), F.col("length")))
    at = size.select("line_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("m").alias("m")), F.struct(F.lit(1).alias("k"), (F.col("length") - F.col("m")).alias("m")))).alias("c")).select("line_id", "c.k", "c.m")
    p = locate(v, at).groupBy("line_id").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{n}{c}") for k, n in ((0, "s"), (1, "e")) for c in ("x", "y")))
    j = chords(v).join(p, "line_id")

    def unit(px: str, py: str, qx: str, qy: str, n: str) -> list:
        h = F.hypot(F.col(qx) - F.col(px), F.col(qy) - F.col(py))
        return [F.coalesce(F.try_divide(F.col(q) - F.col(p), h), F.lit(0.0)).alias(f"{n}u{a}") for p, q, a in ((px, qx, "x"), (py, qy, "y"))]

    return j.select("line_id", F.col("x1").alias("ax"), F.col("y1").alias("ay"), *unit("x1", "y1", "sx", "sy", "a"), F.col("x2").alias("bx"), F.col("y2").alias("by"), *unit("x2", "y2", "ex", "ey", "b"))


def masked(cells: DataFrame, v: DataFrame, p: Parameters = DEFAULTS, res: float = 2, water: DataFrame | None = None, bridge: float = 5) -> DataFrame:
    """(line_id, cx, cy, sigma, cap): each line's cells with the distance factor, 1 in the caps behind its ends ("A", "B") and 0 in the shields around them.

    A cap is the half disc of the buffer's radius behind an end; a shield is what of the caps and of
    the end stretches' own strips lies over the radius less 6 from both ends. With water (edges of polygons as in in_polygons()), cells
    in it are left out, but for those within `bridge` of the line, which are a bridge of sigma 1.
    A line whose ends are nearer than two buffers, and no loop, has a smaller buffer.
    """
    n = near_cells(cells, v, p.extraction.road_buffer, res).join(end_chords(v), "line_id")
    apart = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    n = n.withColumn("buf", F.when(apart < LOOP, F.lit(float(p.extraction.road_buffer))).otherwise(buffer_near_closed(apart, p.extraction.road_buffer))).where("d <= buf")
    buf = F.col("buf")
    if water is not None:
        places = cells.select(F.struct(*CELL).alias("pid"), ((F.col("cx") + 0.5) * res).alias("px"), ((F.col("cy") + 0.5) * res).alias("py"))
        wet = in_polygons(places, water).select("pid.cx", "pid.cy", F.lit(True).alias("wet")).distinct()
        n = n.join(wet, CELL, "left").where(F.col("wet").isNull() | (F.col("d") <= bridge)).withColumn("sigma", F.when(F.col("wet"), 1.0).otherwise(F.col("sigma"))).drop("wet")
    ends = n.groupBy("line_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    n = n.join(ends, "line_id")
    f = 1 - F.coalesce(F.try_divide((F.col("d") - F.col("lo")) * F.lit(float(p.confidence)), F.col("hi") - F.col("lo")), F.lit(0.0))

    def around(e: str) -> tuple:
        dx, dy = F.col("px") - F.col(f"{e}x"), F.col("py") - F.col(f"{e}y")
        along, across = dx * F.col(f"{e}ux") + dy * F.col(f"{e}uy"), F.abs(dy * F.col(f"{e}ux") - dx * F.col(f"{e}uy"))
        return F.hypot(dx, dy), (F.hypot(dx, dy) <= buf) & (along < 0), (along >= 0) & (along <= 20) & (across <= buf)

    (da, cap_a, strip_a), (db, cap_b, strip_b) = around("a"), around("b")
    shield = (cap_a | cap_b | strip_a | strip_b) & (da > buf - 6) & (db > buf - 6)
    sigma = F.when(shield, 0.0).when(cap_a | cap_b, 1.0).otherwise(f * F.col("sigma"))
    cap = F.when(cap_a, "A").when(cap_b, "B")
    return n.select("line_id", *CELL, sigma.alias("sigma"), cap.alias("cap"), "ax", "ay", "bx", "by").where("sigma is not null")


def least_cost_paths(cells: DataFrame, v: DataFrame, p: Parameters = DEFAULTS, res: float = 2, water: DataFrame | None = None) -> DataFrame:
    """(line_id, seq, x, y, conductivity, error): for each line the cheapest way over its masked cells from cap to cap, without the part in the caps.

    Each line is one group; lines are no longer than road_max_len, which bounds its cells. Where
    there is no way, conductivity is 0 and there is one row without a place. A failing line gives a
    row with its error, and the others go on.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        def rows(path: list, value: float, error: str | None = None) -> pd.DataFrame:
            path = path or [(None, None)]
            return pd.DataFrame({"line_id": key[0], "seq": range(1, len(path) + 1), "x": pd.Series([a for a, _ in path], dtype="float64"), "y": pd.Series([b for _, b in path], dtype="float64"), "conductivity": value, "error": error})

        try:
            grid = {(int(a), int(b)): float(s) for a, b, s in zip(pdf.cx, pdf.cy, pdf.sigma)}
            cap = {(int(a), int(b)) for a, b, c in zip(pdf.cx, pdf.cy, pdf.cap) if c}

            def start(side: str, x: float, y: float) -> tuple[int, int]:
                own = pdf[(pdf.cap == side) & (pdf.sigma > 0)]
                own = pdf[pdf.sigma > 0] if own.empty else own
                tx, ty = (own.cx.mean(), own.cy.mean()) if len(own) < len(pdf) else (x / res, y / res)
                gx, gy = own.cx.to_numpy(), own.cy.to_numpy()
                k = np.lexsort((gy, gx, np.hypot(gx - tx, gy - ty)))[0]
                return int(gx[k]), int(gy[k])

            first = pdf.iloc[0]
            cost, path = least_cost(grid, start("A", first.ax, first.ay), start("B", first.bx, first.by), res)
            if not path or not cost:
                return rows([], 0.0)
            length = sum(hypot(c - a, d - b) for (a, b), (c, d) in zip(path, path[1:])) * res
            middle = [q for q in path if q not in cap]
            return rows([((a + 0.5) * res, (b + 0.5) * res) for a, b in middle], round(length / cost, 2))
        except Exception as e:  # one road's failure is its own row
            return rows([], float("nan"), f"{type(e).__name__}: {e}")

    return masked(cells, v, p, res, water).groupBy("line_id").applyInPandas(run, "line_id long, seq long, x double, y double, conductivity double, error string")
