"""Views of the driver's tables as points, cells, profiles, lines and roads: in Spark, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.scalar import road_class
from wayfold.operators.profiles import ground_profile, slope_of, vegetation_profile


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Returns of a scan: a row for each line item."""
    return table(spark, sf, "lineitem").select(
        ((F.col("l_partkey") % 400).cast("double") / 2).alias("x"),
        (F.col("l_suppkey") % 100).cast("double").alias("y"),
        (F.col("l_quantity") / 10).alias("z"),
        F.floor(F.col("l_extendedprice") / 25).cast("int").alias("intensity"),
        F.col("l_linenumber").alias("psid"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 9).otherwise(1).alias("cls"),
        (F.round(F.col("l_tax") * 100).cast("int") * 3 - 12).alias("angle"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The least z of each unit cell."""
    return points(spark, sf).groupBy(F.floor("x").cast("int").alias("cx"), F.floor("y").cast("int").alias("cy")).agg(F.min("z").alias("v"))


def nodes_of_lines(orders: DataFrame, shift) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = orders.withColumn("seq", F.row_number().over(w).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("n > 1")
    x = (F.col("o_custkey") % 100).cast("double") * 60 + F.col("seq").cast("double") * 10
    y = F.floor(F.col("o_custkey") / 100).cast("double") * 60 + (F.col("o_orderkey") * 7 % 41).cast("double") - 20
    return v.select(F.col("o_custkey").alias("line_id"), "seq", x.alias("x"), (y + shift).alias("y"))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Zigzag lines, one for each customer with two orders or more, in rows and columns that overlap their neighbours."""
    return nodes_of_lines(table(spark, sf, "orders"), F.lit(0.0))


def vertices_cor(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines, as if relocated by -3 to 3."""
    return nodes_of_lines(table(spark, sf, "orders"), ((F.col("o_orderkey") % 7) - 3).cast("double"))


def roads(spark: SparkSession, sf: str) -> DataFrame:
    score = F.round(F.greatest(F.least((F.col("c_acctbal") + 1000) / 110, F.lit(100.0)), F.lit(0.0)), 1)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("line_id"), score.alias("score")).withColumn("class", road_class(F.col("score")))


def slice_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points within 15 of an axis along y = 50, in slices of 10 along it."""
    p = points(spark, sf).withColumns({"slice_id": F.floor(F.col("x") / 10).cast("int"), "pos": F.col("y") - 50}).where(F.abs("pos") <= 15)
    return p.withColumn("xr", F.round(F.col("pos") / 0.5) * 0.5)


def ground(spark: SparkSession, sf: str) -> DataFrame:
    return slope_of(ground_profile(slice_points(spark, sf)))


def vegetation(spark: SparkSession, sf: str) -> DataFrame:
    return vegetation_profile(slice_points(spark, sf))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Values of each user's events in order, each fifth of which is missing."""
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).cast("bigint").alias("i"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))


def water(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle for each nation."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("gid"), ((k % 5).cast("double") * 40 + 5.25).alias("x0"), (F.floor(k / 5).cast("double") * 20 + 5.25).alias("y0")).withColumns({"x1": F.col("x0") + 20, "y1": F.col("y0") + 8})


SQL = {
    "points": """SELECT CAST(l_partkey % 400 AS DOUBLE) / 2 AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, l_quantity / 10 AS z, CAST(floor(l_extendedprice / 25) AS INT) AS intensity,
 l_linenumber AS psid, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 9 ELSE 1 END AS cls, CAST(round(l_tax * 100) AS INT) * 3 - 12 AS angle FROM lineitem""",
    "pc": "SELECT *, CAST(floor(x) AS INT) AS cx, CAST(floor(y) AS INT) AS cy FROM points",
    "cells": "SELECT cx, cy, min(z) AS v FROM pc GROUP BY cx, cy",
    "dtm": "SELECT cx, cy, min(z) AS dtm FROM pc WHERE cls = 2 GROUP BY cx, cy",
    "np": "SELECT pc.*, round(z - dtm, 6) AS zn FROM pc JOIN dtm USING (cx, cy)",
    "vraw": """SELECT o_custkey AS line_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, count(*) OVER (PARTITION BY o_custkey) AS n,
 CAST(floor(o_custkey / 100) AS DOUBLE) * 60 + CAST(o_orderkey * 7 % 41 AS DOUBLE) - 20 AS y, CAST(o_orderkey % 7 - 3 AS DOUBLE) AS dy FROM orders""",
    "vertices": "SELECT line_id, seq, CAST(line_id % 100 AS DOUBLE) * 60 + CAST(seq AS DOUBLE) * 10 AS x, y FROM vraw WHERE n > 1",
    "vertices_cor": "SELECT line_id, seq, CAST(line_id % 100 AS DOUBLE) * 60 + CAST(seq AS DOUBLE) * 10 AS x, y + dy AS y FROM vraw WHERE n > 1",
    "mv": """SELECT *, sum(seg) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM
 (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS seg FROM vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq))""",
    "segs": """SELECT * FROM (SELECT line_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, m AS m1, lead(m) OVER w AS m2, max(m) OVER (PARTITION BY line_id) AS len
 FROM mv WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL""",
    "lens": "SELECT line_id, max(m) AS length FROM mv GROUP BY line_id",
    "ends": """SELECT line_id, false AS is_end, arg_min(x, seq) AS x, arg_min(y, seq) AS y FROM vertices GROUP BY line_id
 UNION ALL SELECT line_id, true, arg_max(x, seq), arg_max(y, seq) FROM vertices GROUP BY line_id""",
    "roads": """SELECT line_id, score, CASE WHEN score < 25 THEN 4 WHEN score < 50 THEN 3 WHEN score < 75 THEN 2 WHEN score <= 101 THEN 1 END AS class FROM
 (SELECT c_custkey AS line_id, round(greatest(least((c_acctbal + 1000) / 110, 100), 0), 1) AS score FROM customer)""",
    "sp": "SELECT *, CAST(floor(x / 10) AS INT) AS slice_id, y - 50 AS pos, round((y - 50) / 0.5) * 0.5 AS xr FROM points WHERE abs(y - 50) <= 15",
    "g0": "SELECT slice_id, xr, count(*) AS n, avg(z) AS avg_z, stddev_samp(z) AS sd_z FROM sp WHERE cls IN (2, 9) GROUP BY slice_id, xr",
    "series": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events",
    "water": "SELECT n_nationkey AS gid, CAST(n_nationkey % 5 AS DOUBLE) * 40 + 5.25 AS x0, floor(n_nationkey / 5) * 20 + 5.25 AS y0, CAST(n_nationkey % 5 AS DOUBLE) * 40 + 25.25 AS x1, floor(n_nationkey / 5) * 20 + 13.25 AS y1 FROM nation",
}


def with_views(body: str, *names: str, **more: str) -> str:
    """body after the named views and those that they need, then `more`, in order."""
    need = {"pc": ["points"], "cells": ["pc"], "dtm": ["pc"], "np": ["dtm"], "vertices": ["vraw"], "vertices_cor": ["vraw"], "mv": ["vertices"], "segs": ["mv"], "lens": ["mv"], "ends": ["vertices"], "sp": ["points"], "g0": ["sp"]}
    order: list[str] = []

    def add(n: str) -> None:
        for d in need.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join([f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]) + " " + body
