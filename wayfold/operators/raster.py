"""Grids as sparse cell tables (cx, cy, value ...): rasterising points, map algebra, neighbourhoods, adjacency.

Every operator is a grouped aggregate or an equi-join on cell keys. A neighbourhood is not a
self-join: each cell is sent to the cells whose window holds it, and those are grouped, so partial
sums combine before the shuffle and no cell meets all others.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["cx", "cy"]


def cell_of(v: str | Column, res: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / res).cast("int")


def to_cells(points: DataFrame, res: float = 1) -> DataFrame:
    """points plus the cell (cx, cy) of each."""
    return points.withColumns({"cx": cell_of("x", res), "cy": cell_of("y", res)})


def rasterize(points: DataFrame, res: float, *aggs: Column, by: Iterable[str] = ()) -> DataFrame:
    """One row for each cell (of each `by`) that holds points."""
    return to_cells(points, res).groupBy(*by, *CELL).agg(*aggs)


def block(cells: DataFrame, k: int, how: str = "mean", skip_null: bool = True, value: str = "v", by: Iterable[str] = ()) -> DataFrame:
    """Blocks of k x k cells; with skip_null false, a block that lacks any of its cells is null."""
    f = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    out = f(value) if skip_null else F.when(F.count(value) == k * k, f(value))
    return cells.withColumns({c: F.floor(F.col(c) / k).cast("int") for c in CELL}).groupBy(*by, *CELL).agg(out.alias(value))


def spread(cells: DataFrame, weights: Mapping[tuple[int, int], float], value: str = "v") -> DataFrame:
    """A row (cx, cy, dx, dy, w, v) at each cell whose window holds the cell's value; (dx, dy) is where the value lies from there."""
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in weights.items()))
    moved = cells.select(*CELL, F.col(value).alias("v"), F.explode(offsets).alias("o"))
    return moved.select((F.col("cx") - F.col("o.dx")).alias("cx"), (F.col("cy") - F.col("o.dy")).alias("cy"), "o.dx", "o.dy", "o.w", "v")


def square(n: int, centre: float = 1) -> dict[tuple[int, int], float]:
    """An n x n window of weights 1, but for the centre."""
    h = n // 2
    return {(dx, dy): centre if dx == dy == 0 else 1.0 for dx in range(-h, h + 1) for dy in range(-h, h + 1)}


def window(cells: DataFrame, weights: Mapping[tuple[int, int], float], out: Column, value: str = "v") -> DataFrame:
    """out, an aggregate over (dx, dy, w, v), for each cell that exists: rows at other cells are dropped by their lack of a centre."""
    here = F.bool_or((F.col("dx") == 0) & (F.col("dy") == 0))
    return spread(cells, weights, value).groupBy(*CELL).agg(here.alias("here"), out.alias(value)).where("here").drop("here")


def focal_mean(cells: DataFrame, n: int, whole: bool, centre: float = 1, value: str = "v") -> DataFrame:
    """The mean of weighted values by the number of cells; with whole, null where the window lacks a cell."""
    mean = F.avg(F.col("w") * F.col("v"))
    return window(cells, square(n, centre), F.when(F.count("v") == n * n, mean) if whole else mean, value)


def roughness(cells: DataFrame, value: str = "v") -> DataFrame:
    """Greatest less least value of the 3 x 3 window; null where it lacks a cell."""
    return window(cells, square(3), F.when(F.count("v") == 9, F.max("v") - F.min("v")), value)


def _at(dx: int, dy: int) -> Column:
    return F.sum(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("v")))


def slope(cells: DataFrame, res: float = 1, value: str = "v") -> DataFrame:
    """Degrees by the differences of the 8 neighbours, those beside and above counted twice; null where one is missing."""
    gx = (_at(1, -1) + 2 * _at(1, 0) + _at(1, 1) - _at(-1, -1) - 2 * _at(-1, 0) - _at(-1, 1)) / (8 * res)
    gy = (_at(-1, 1) + 2 * _at(0, 1) + _at(1, 1) - _at(-1, -1) - 2 * _at(0, -1) - _at(1, -1)) / (8 * res)
    return window(cells, square(3), F.degrees(F.atan(F.hypot(gx, gy))), value)


#: The rows of the vertical Sobel kernels of 3 and of 5.
SOBEL = {3: ((1, 2, 1), (0, 0, 0), (-1, -2, -1)), 5: ((2, 2, 4, 2, 2), (1, 1, 2, 1, 1), (0, 0, 0, 0, 0), (-1, -1, -2, -1, -1), (-2, -2, -4, -2, -2))}


def sobel(cells: DataFrame, size: int = 3, value: str = "v") -> DataFrame:
    """The length of the two Sobel sums, missing and null cells counting 0; null cells stay null."""
    k, h = SOBEL[size], size // 2
    weights = {(dx, dy): 1.0 for dx in range(-h, h + 1) for dy in range(-h, h + 1)}

    def total(pick) -> Column:
        out = F.lit(0.0)
        for dx, dy in weights:
            if pick(dx, dy):
                out = out + pick(dx, dy) * F.coalesce(_at(dx, dy), F.lit(0.0))
        return out

    edge = F.hypot(total(lambda dx, dy: k[dy + h][dx + h]), total(lambda dx, dy: k[dx + h][dy + h]))
    own = _at(0, 0)
    return window(cells, weights, F.when(own.isNotNull(), edge), value)


def stretch(cells: DataFrame, by: Iterable[str] = (), value: str = "v", upper: float | None = None) -> DataFrame:
    """Values rescaled to 0..1 by the least and greatest of each layer (or its upper quantile, above which all are 1); a flat layer is 0."""
    by = list(by)
    top = F.max(value) if upper is None else F.percentile(value, upper)
    ends = cells.groupBy(*by).agg(F.min(value).alias("_lo"), top.alias("_hi"))
    joined = cells.join(F.broadcast(ends), by) if by else cells.crossJoin(F.broadcast(ends))
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return joined.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)))).drop("_lo", "_hi")


def fill_extent(cells: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """All cells of an extent, with nulls where the table has none; those outside are cropped."""
    spark = cells.sparkSession
    grid = spark.range(x0, x1 + 1).select(F.col("id").cast("int").alias("cx")).select("cx", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("cy"))
    return grid.join(cells.where(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)), CELL, "left")


def adjacency(cells: DataFrame, value: str = "v") -> DataFrame:
    """(ax, ay, bx, by, va, vb, dist): each pair of cells that touch, once: the four neighbours ahead."""
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))))
    a = cells.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col(value).alias("va"), F.explode(ahead).alias("o"))
    a = a.select("ax", "ay", "va", (F.col("ax") + F.col("o.dx")).alias("bx"), (F.col("ay") + F.col("o.dy")).alias("by"), F.hypot(F.col("o.dx").cast("double"), F.col("o.dy").cast("double")).alias("dist"))
    b = cells.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col(value).alias("vb"))
    return a.join(b, ["bx", "by"]).select("ax", "ay", "bx", "by", "va", "vb", "dist")


def conductance(cells: DataFrame, res: float = 1, correct: bool = True, value: str = "v") -> DataFrame:
    """Edges (ax, ay, bx, by, w): the mean of both cells, null as 0, by the distance of their centres; edges of 0 lead nowhere and are left out."""
    w = F.coalesce((F.col("va") + F.col("vb")) / 2, F.lit(0.0))
    return adjacency(cells, value).select("ax", "ay", "bx", "by", (w / (F.col("dist") * res) if correct else w).alias("w")).where("w > 0")


def by_flightline(points: DataFrame, res: float, agg: Column, cap: str | None, across: str = "max", scaled: bool = True) -> DataFrame:
    """One band from all flightlines (psid): aggregate by flightline and cell, cap at that line's q95, rescale to 0..1, then reduce across lines.

    cap names what is capped: "cell" values after aggregating, or a column of points before; None caps nothing.
    """
    if cap and cap != "cell":
        q = points.groupBy("psid").agg(F.percentile(cap, 0.95).alias("_q"))
        points = points.join(F.broadcast(q), "psid").withColumn(cap, F.least(F.col(cap).cast("double"), F.col("_q"))).drop("_q")
    layers = rasterize(points, res, agg.alias("v"), by=["psid"])
    if cap == "cell":
        q = layers.groupBy("psid").agg(F.percentile("v", 0.95).alias("_q"))
        layers = layers.join(F.broadcast(q), "psid").withColumn("v", F.least(F.col("v"), F.col("_q"))).drop("_q")
    if scaled:
        layers = stretch(layers, ["psid"])
    return layers.groupBy(*CELL).agg((F.max if across == "max" else F.min)("v").alias("v"))


def distance_factor(cells: DataFrame, confidence: float, distance: str = "d", by: Iterable[str] = ()) -> DataFrame:
    """Adds f, 1 at the least distance and 1 - confidence less at the greatest, of each `by`; the ends are aggregated first, so no group lies in one task."""
    keys = list(by)
    lo, hi = F.col("_lo"), F.col("_hi")
    span = cells.groupBy(*keys).agg(F.min(distance).alias("_lo"), F.max(distance).alias("_hi"))
    cells = cells.join(span, keys) if keys else cells.crossJoin(F.broadcast(span))
    return cells.withColumn("f", 1 - F.coalesce(F.try_divide((F.col(distance) - lo) * F.lit(float(confidence)), hi - lo), F.lit(0.0))).drop("_lo", "_hi")


def flat_across(cells: DataFrame, centre: DataFrame, res: float, value: str = "v") -> DataFrame:
    """Cells of slices with the value of the row that xc of (slice_id, xc) lies in, all across; null where that row has no cell."""
    row = cells.join(centre.select("slice_id", F.floor(F.col("xc") / res).cast("int").alias("_cy")), "slice_id").where("cy = _cy")
    return cells.drop(value).join(row.select("slice_id", "cx", value), ["slice_id", "cx"], "left")


def first_cell(cells: DataFrame, value: str = "v") -> DataFrame:
    """(slice_id, value): that of each slice's first cell, from the top and the left."""
    return cells.groupBy("slice_id").agg(F.min_by(value, F.struct(-F.col("cy"), F.col("cx"))).alias(value))
