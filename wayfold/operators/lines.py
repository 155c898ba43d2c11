"""Line operators over vertex tables (line_id, seq, x, y), by windows along each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfold.functions.scalar import turn

#: Fixed value: a line whose ends are nearer than this is a loop.
LOOP = 2


def along(order: str = "seq") -> WindowSpec:
    return Window.partitionBy("line_id").orderBy(order)


def measured(v: DataFrame) -> DataFrame:
    """Vertices plus seg (length from the one before) and m (length from the start)."""
    seg = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along())), F.lit(0.0))
    return v.withColumn("seg", seg).withColumn("m", F.sum("seg").over(along().rowsBetween(Window.unboundedPreceding, 0)))


def segments(v: DataFrame) -> DataFrame:
    """(line_id, seq, x1, y1, x2, y2, m1, m2, len): each pair of following vertices."""
    m = measured(v)
    cols = {"x2": F.lead("x").over(along()), "y2": F.lead("y").over(along()), "m2": F.lead("m").over(along()), "len": F.sum("seg").over(Window.partitionBy("line_id"))}
    return m.withColumns(cols).where("x2 is not null").select("line_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", F.col("m").alias("m1"), "m2", "len")


def lengths(v: DataFrame) -> DataFrame:
    return measured(v).groupBy("line_id").agg(F.sum("seg").alias("length"))


def ends(v: DataFrame) -> DataFrame:
    """(line_id, is_end, x, y): the first and the last vertex of each line."""
    pick = v.groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("is_end"), F.col("a").alias("p")), F.struct(F.lit(True).alias("is_end"), F.col("b").alias("p"))))
    return pick.select("line_id", both.alias("e")).select("line_id", "e.is_end", "e.p.x", "e.p.y")


def chords(v: DataFrame) -> DataFrame:
    """(line_id, x1, y1, x2, y2): from the first to the last vertex."""
    return v.groupBy("line_id").agg(*(f(c, "seq").alias(f"{c}{k}") for k, f in ((1, F.min_by), (2, F.max_by)) for c in ("x", "y")))


def sinuosity(v: DataFrame) -> DataFrame:
    """Length by the distance of the ends, to 2 decimals; null if they meet."""
    c = chords(v).withColumn("chord", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).select("line_id", "chord")
    return lengths(v).join(c, "line_id").select("line_id", F.round(F.try_divide("length", "chord"), 2).alias("sinuosity"))


def headings(v: DataFrame) -> DataFrame:
    """(line_id, head, tail): degrees outward at the first and the last vertex."""
    back = Window.partitionBy("line_id").orderBy(F.desc("seq"))
    two = v.withColumns({"a": F.row_number().over(along()), "b": F.row_number().over(back)}).where("a <= 2 or b <= 2")

    def at(side: str, k: int, c: str) -> Column:
        return F.max(F.when(F.col(side) == k, F.col(c)))

    def deg(s: str) -> Column:
        return F.degrees(F.atan2(at(s, 1, "y") - at(s, 2, "y"), at(s, 1, "x") - at(s, 2, "x")))

    return two.groupBy("line_id").agg(deg("a").alias("head"), deg("b").alias("tail"))


def turning_angles(v: DataFrame) -> DataFrame:
    """(line_id, seq, angle) at inner vertices: by how many degrees the line turns there."""
    w = {f"{k}{c}": f(c).over(along()) for k, f in (("p", F.lag), ("n", F.lead)) for c in ("x", "y")}
    inner = v.withColumns(w).where("px is not null and nx is not null")
    return inner.select("line_id", "seq", turn(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("angle"))


def locate(v: DataFrame, at: DataFrame, from_end: bool = False, strict: bool = False) -> DataFrame:
    """Points at measures: at is (line_id, k, m); gives (line_id, k, m, x, y).

    Measures off the line give no row, or an error with strict. With from_end they count from the
    line's end. Each line is cut in as many equal stretches as it has segments, and a measure meets
    the segments of its own stretch only, so no line's measures meet all of its segments.
    """
    s = segments(v)
    size = s.groupBy("line_id").agg(F.max("len").alias("len"), F.count("*").alias("n"))

    def stretch(m: str) -> Column:
        return F.coalesce(F.floor(F.try_divide(F.col(m) * F.col("n"), F.col("len"))), F.lit(0)).cast("bigint")

    marks = at.select("line_id", "k", "m").join(size, "line_id")
    if strict:
        off = (F.col("m") > F.col("len") + 1e-9) | (F.col("m") < 0)
        marks = marks.withColumn("m", F.when(off, F.raise_error(F.lit("a measure lies off its line"))).otherwise(F.col("m")))
    marks = marks.withColumn("at", F.col("len") - F.col("m") if from_end else F.col("m")).where("at >= 0 and at <= len")
    marks = marks.select("line_id", "k", "m", "at", stretch("at").alias("_s"))
    parts = s.join(size.select("line_id", "n"), "line_id").withColumn("_s", F.explode(F.sequence(stretch("m1"), stretch("m2"))))
    on = parts.join(marks, ["line_id", "_s"]).where((F.col("at") >= F.col("m1")) & ((F.col("at") < F.col("m2")) | ((F.col("at") <= F.col("m2")) & (F.col("m2") == F.col("len")))))
    t = F.coalesce(F.try_divide(F.col("at") - F.col("m1"), F.col("m2") - F.col("m1")), F.lit(0.0))
    first = on.groupBy("line_id", "k", "m").agg(F.min_by(F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y")), "seq").alias("p"))
    return first.select("line_id", "k", "m", "p.x", "p.y")


def rescaled(v: DataFrame, length: DataFrame) -> DataFrame:
    """Vertices plus place: the share of the line up to each, times the length that (line_id, length) gives; null for a line of no length."""
    m = measured(v)
    total = F.max("m").over(Window.partitionBy("line_id"))
    return m.withColumn("_t", total).join(length.select("line_id", "length"), "line_id").withColumn("place", F.try_divide(F.col("m"), F.col("_t")) * F.col("length")).drop("_t", "seg", "m", "length")


def cropped(v: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(line_id, seq, x1, y1, x2, y2): what of each segment lies in a box, its border included; a mere touch is left out."""
    s = segments(v).where((F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x1) & (F.greatest("y1", "y2") >= y0) & (F.least("y1", "y2") <= y1))

    def span(a: str, b: str, lo: float, hi: float) -> tuple[Column, Column]:
        d = F.col(b) - F.col(a)
        p, q = F.try_divide(lo - F.col(a), d), F.try_divide(hi - F.col(a), d)
        return F.coalesce(F.least(p, q), F.lit(0.0)), F.coalesce(F.greatest(p, q), F.lit(1.0))

    (a0, a1), (b0, b1) = span("x1", "x2", x0, x1), span("y1", "y2", y0, y1)
    s = s.withColumns({"_a": F.greatest(F.lit(0.0), a0, b0), "_b": F.least(F.lit(1.0), a1, b1)}).where("_a < _b")

    def at(c: str, t: str) -> Column:
        return F.col(f"{c}1") + F.col(t) * (F.col(f"{c}2") - F.col(f"{c}1"))

    return s.select("line_id", "seq", at("x", "_a").alias("x1"), at("y", "_a").alias("y1"), at("x", "_b").alias("x2"), at("y", "_b").alias("y2"))


def extend(v: DataFrame, distance: float, head: bool = True, tail: bool = True) -> DataFrame:
    """Moves the end vertices outward along their headings."""
    h = headings(v)
    w = Window.partitionBy("line_id")
    j = v.withColumns({"lo": F.min("seq").over(w), "hi": F.max("seq").over(w)}).join(h, "line_id")
    angle = F.radians(F.when((F.col("seq") == F.col("lo")) & F.lit(head), F.col("head")).when((F.col("seq") == F.col("hi")) & F.lit(tail), F.col("tail")))
    return j.select("line_id", "seq", (F.col("x") + F.coalesce(distance * F.cos(angle), F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce(distance * F.sin(angle), F.lit(0.0))).alias("y"))


def substring(v: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The part of each line from the share lo to the share hi of its length, as (line_id, seq, x, y)."""
    size = lengths(v)
    cuts = size.select("line_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), (lo * F.col("length")).alias("m")), F.struct(F.lit(1).alias("k"), F.least(hi * F.col("length"), F.col("length")).alias("m")))).alias("c")).select("line_id", "c.k", "c.m")
    inner = measured(v).join(size, "line_id").where((F.col("m") > lo * F.col("length")) & (F.col("m") < hi * F.col("length"))).select("line_id", "m", "x", "y")
    every = inner.union(locate(v, cuts).select("line_id", "m", "x", "y"))
    return every.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("m", "x", "y")).cast("bigint").alias("seq"), "x", "y")


def equal_cuts(v: DataFrame, length: float) -> DataFrame:
    """(line_id, k, m): measures of slices of `length`; shares have 4 decimals and the last is the end."""
    size = lengths(v)
    n = F.floor(F.col("length") / length).cast("int")
    steps = size.select("line_id", "length", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)))).alias("k"), F.greatest(n, F.lit(1)).alias("n"))
    share = F.when(F.col("k") == F.col("n"), 1.0).otherwise(F.round(F.col("k") * length / F.col("length"), 4))
    return steps.select("line_id", "k", (share * F.col("length")).alias("m"))


def samples(v: DataFrame, n: Column) -> DataFrame:
    """Both ends and n points at the middles of n equal parts of each line: (line_id, k, x, y)."""
    size = lengths(v).withColumn("n", n)
    at = size.select("line_id", F.explode(F.sequence(F.lit(0), F.col("n") + 1)).alias("k"), "n", "length")
    m = F.when(F.col("k") == 0, 0.0).when(F.col("k") > F.col("n"), F.col("length")).otherwise((F.col("k") - 0.5) / F.col("n") * F.col("length"))
    return locate(v, at.select("line_id", "k", m.alias("m"))).select("line_id", "k", "x", "y")


def nearest_on_line(v: DataFrame, points: DataFrame) -> DataFrame:
    """For each (line_id, pid, px, py) the nearest point of that line: (line_id, pid, m, dist, x, y); equal ones by the first segment."""
    s = segments(v).join(points, "line_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("x1")) * dx + (F.col("py") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    on = s.withColumn("t", t).withColumns({"x": F.col("x1") + F.col("t") * dx, "y": F.col("y1") + F.col("t") * dy, "m": F.col("m1") + F.col("t") * (F.col("m2") - F.col("m1"))})
    on = on.withColumn("dist", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")))
    best = on.groupBy("line_id", "pid").agg(F.min_by(F.struct("m", "dist", "x", "y"), F.struct(F.round("dist", 9), "seq")).alias("b"))
    return best.select("line_id", "pid", "b.m", "b.dist", "b.x", "b.y")


def split_at(v: DataFrame, at: DataFrame) -> DataFrame:
    """Cuts each line at its measure (line_id, m): (line_id, part, seq, x, y); both parts have the cut. Lines without one, or cut at an end, stay one part."""
    size = lengths(v)
    cut = at.join(size, "line_id").where((F.col("m") > 0) & (F.col("m") < F.col("length"))).select("line_id", F.lit(0).alias("k"), "m")
    point = locate(v, cut).select("line_id", F.col("m").alias("cut"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    j = measured(v).join(point, "line_id", "left")
    old = j.where("cut is null or m <> cut").select("line_id", F.when(F.col("cut").isNull() | (F.col("m") < F.col("cut")), 1).otherwise(2).alias("part"), "m", "x", "y")
    new = point.select("line_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), F.col("cut").alias("m"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return old.union(new).select("line_id", "part", F.row_number().over(Window.partitionBy("line_id", "part").orderBy("m", "x", "y")).cast("bigint").alias("seq"), "x", "y")


def without_repeats(v: DataFrame) -> DataFrame:
    """Lines less vertices equal to the one before."""
    same = (F.col("x") == F.lag("x").over(along())) & (F.col("y") == F.lag("y").over(along()))
    return v.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").drop("same")


def difference_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """(line_id, index): the area of the ring of a and b by its perimeter, b reversed if the lines' starts are nearer than start and end."""
    ca, cb = (chords(t).select("line_id", *(F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2"))) for t, n in ((a, "a"), (b, "b")))
    near = F.hypot(F.col("a_x2") - F.col("b_x2"), F.col("a_y2") - F.col("b_y2")) <= F.hypot(F.col("a_x2") - F.col("b_x1"), F.col("a_y2") - F.col("b_y1"))
    way = ca.join(cb, "line_id").select("line_id", near.alias("flip"))
    ring = a.select("line_id", F.lit(0).alias("part"), F.col("seq").alias("o"), "x", "y").union(b.join(way, "line_id").select("line_id", F.lit(1), F.when(F.col("flip"), -F.col("seq")).otherwise(F.col("seq")), "x", "y"))
    w = Window.partitionBy("line_id").orderBy("part", "o")
    first = Window.partitionBy("line_id").orderBy("part", "o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(first)), F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    r = ring.withColumns({"nx": nx, "ny": ny}).groupBy("line_id").agg(F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("per"))
    return r.select("line_id", F.try_divide("area", "per").alias("index"))


def along_distances(a: DataFrame, b: DataFrame, step: float = 10) -> DataFrame:
    """(line_id, p50, p90, p100, end_max): distances of points sampled alike on both lines, and the greater one at the ends."""
    n = lengths(b).select("line_id", F.ceil(F.col("length") / step).cast("int").alias("n"))

    def of(t: DataFrame, name: str) -> DataFrame:
        at = lengths(t).join(n, "line_id").select("line_id", "n", "length", F.explode(F.sequence(F.lit(0), F.col("n") + 1)).alias("k"))
        m = F.when(F.col("k") == 0, 0.0).when(F.col("k") > F.col("n"), F.col("length")).otherwise((F.col("k") - 0.5) / F.col("n") * F.col("length"))
        return locate(t, at.select("line_id", "k", m.alias("m"))).select("line_id", "k", F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))

    d = of(a, "a").join(of(b, "b"), ["line_id", "k"]).join(n, "line_id").withColumn("d", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    q = F.percentile("d", [0.5, 0.9, 1.0])
    return d.groupBy("line_id").agg(q.alias("q"), F.max(F.when((F.col("k") == 0) | (F.col("k") > F.col("n")), F.col("d"))).alias("end_max")).select("line_id", *(F.get("q", i).alias(f"p{p}") for i, p in enumerate((50, 90, 100))), "end_max")
