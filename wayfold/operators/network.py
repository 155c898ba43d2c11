"""Road networks: neighbours of line ends, junction and crossing checks, snapping, and the best connexion at a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.scalar import angle_gap

from .lines import ends, headings, segments
from .spatial import crossings, within_distance


def numbered_ends(v: DataFrame) -> DataFrame:
    """(eid, line_id, is_end, x, y): starts have the id 2 line_id, ends one more."""
    e = ends(v)
    return e.select((F.col("line_id") * 2 + F.col("is_end").cast("int")).alias("eid"), "line_id", "is_end", "x", "y")


def end_pairs(v: DataFrame, radius: float) -> DataFrame:
    """(aid, bid, ax, ay, bx, by) of ends within the radius, each with itself too."""
    e = numbered_ends(v)
    return within_distance(e.select(F.col("eid").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay")), e.select(F.col("eid").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by")), radius)


def neighbour_sets(v: DataFrame, radius: float) -> DataFrame:
    """(ids, x, y, near): the different sets of over one end within the radius of some end, with their mean place; near is how many lie at their first member's place."""
    p = end_pairs(v, radius)
    sets = p.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct(F.col("bid").alias("id"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("m")).where(F.size("m") > 1)
    one = sets.groupBy(F.transform("m", lambda s: s.id).alias("ids")).agg(F.first("m").alias("m"))
    n = F.size("m")
    mean = lambda c: F.aggregate("m", F.lit(0.0), lambda a, s: a + s[c]) / n
    same = F.size(F.filter("m", lambda s: (s.x == F.get("m", 0).x) & (s.y == F.get("m", 0).y)))
    return one.select("ids", mean("x").alias("x"), mean("y").alias("y"), same.alias("near"))


def missing_junctions(v: DataFrame, tolerance: float = 8) -> DataFrame:
    """(x, y, nb_connected, nb_unconnected): places where ends come near one another and not all meet."""
    s = neighbour_sets(v, tolerance)
    return s.select("x", "y", F.col("near").cast("int").alias("nb_connected"), (F.size("ids") - F.col("near")).cast("int").alias("nb_unconnected")).where("nb_unconnected > 0")


def snap_simple(v: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(lines, warnings): ends go to the mean place of a neighbour set within the tolerance; of several sets that of the greatest first members, compared in order, since later sets overwrite earlier ones.

    warnings lists lines whose two ends meet afterwards.
    """
    c = neighbour_sets(v, tolerance)
    e = numbered_ends(v)
    hit = within_distance(c.select(F.col("ids").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay")), e.select(F.col("eid").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by")), tolerance)
    to = hit.groupBy("bid").agg(F.max_by(F.struct("ax", "ay"), "aid").alias("p")).select((F.call_function("div", F.col("bid"), F.lit(2))).alias("line_id"), (F.col("bid") % 2).alias("e"), F.col("p.ax").alias("nx"), F.col("p.ay").alias("ny"))
    w = Window.partitionBy("line_id")
    k = v.withColumns({"lo": F.min("seq").over(w), "hi": F.max("seq").over(w)}).withColumn("e", F.when(F.col("seq") == F.col("lo"), 0).when(F.col("seq") == F.col("hi"), 1).cast("bigint"))
    lines = k.join(to, ["line_id", "e"], "left").select("line_id", "seq", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))
    met = ends(lines).groupBy("line_id").agg(F.count_distinct("x", "y").alias("n"), F.first("x").alias("x"), F.first("y").alias("y")).where("n = 1").drop("n")
    return lines, met


def check_crossings(v: DataFrame) -> DataFrame:
    """(x, y): the different places, to 6 decimals, where two lines cross."""
    return crossings(segments(v)).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).distinct()


def best_connexion(members: DataFrame) -> DataFrame:
    """(node, id1, id2): the two members of each node most likely one road: by the greatest angle, all within 7.5 degrees of which count as straight, then the least sum of classes (0 as 5), then the greatest sum of scores, then ids.

    members: (node, id, heading, class, score). A node's pairs join within it; nodes are small.
    """
    m = members.withColumn("class", F.when(F.col("class") == 0, 5).otherwise(F.col("class")))
    a = m.select("node", *(F.col(c).alias(f"a_{c}") for c in ("id", "heading", "class", "score")))
    b = m.select("node", *(F.col(c).alias(f"b_{c}") for c in ("id", "heading", "class", "score")))
    p = a.join(b, "node").where("a_id < b_id").withColumn("angle", F.round(angle_gap(F.col("a_heading"), F.col("b_heading")), 6))
    top = F.max("angle").over(Window.partitionBy("node"))
    p = p.withColumn("straight", F.when(F.col("angle") >= top - 7.5, 180.0).otherwise(F.col("angle")))
    w = Window.partitionBy("node").orderBy(F.desc("straight"), F.col("a_class") + F.col("b_class"), F.desc(F.round(F.col("a_score") + F.col("b_score"), 6)), "a_id", "b_id")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", F.col("a_id").alias("id1"), F.col("b_id").alias("id2"))


def node_members(v: DataFrame, roads: DataFrame, grid_x: float, grid_y: float) -> DataFrame:
    """(node, id, line_id, is_end, heading, class, score): ends on the same place of a coarse grid are one node; alone they are none."""
    e = numbered_ends(v).join(headings(v), "line_id")
    node = F.concat_ws("_", F.round(F.col("x") / grid_x).cast("int").cast("string"), F.round(F.col("y") / grid_y).cast("int").cast("string"))
    e = e.select(node.alias("node"), F.concat_ws("_", F.col("line_id").cast("string"), F.col("is_end").cast("string")).alias("id"), "line_id", "is_end", F.when(F.col("is_end"), F.col("tail")).otherwise(F.col("head")).alias("heading"))
    e = e.withColumn("n", F.count("*").over(Window.partitionBy("node"))).where("n > 1").drop("n")
    return e.join(roads.select("line_id", "class", "score"), "line_id", "left")
