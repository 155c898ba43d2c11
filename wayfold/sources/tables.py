"""Where points, grids and lines come from and go to."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.lines import segments
from wayfold.operators.spatial import bucket


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the cluster's shared folder; a temporary folder only where the session names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-"))
    return df.checkpoint()


def write_tiles(points: DataFrame, path: str, size: float = 300) -> None:
    """Points as Parquet, a folder for each tile, so that a reader of a region opens only its tiles."""
    tiled = points.withColumns({"tile_x": bucket(F.col("x"), size), "tile_y": bucket(F.col("y"), size)})
    tiled.repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").parquet(path)


def read_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, size: float = 300) -> DataFrame:
    """Points of a box (x0, y0, x1, y1), or all. Tiles prune folders, and the bounds go down to the Parquet scan."""
    points = spark.read.parquet(path)
    missing = {"tile_x", "tile_y"} - set(points.columns)
    if missing:
        raise ValueError(f"{path} is not tiled: it lacks {', '.join(sorted(missing))}; write it with write_tiles()")
    if box is None:
        return points.drop("tile_x", "tile_y")
    x0, y0, x1, y1 = box
    at = [int(v // size) for v in box]
    near = F.col("tile_x").between(at[0], at[2]) & F.col("tile_y").between(at[1], at[3])
    return points.where(near & F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).drop("tile_x", "tile_y")


def clip_to_lines(points: DataFrame, lines: DataFrame, reach: float) -> DataFrame:
    """(line_id, points ...) for points within reach of each line, each once a line: segments go to the buckets around them and meet only points there."""
    s = segments(lines).select("line_id", "x1", "y1", "x2", "y2")
    s = s.withColumn("gx", F.explode(F.sequence(bucket(F.least("x1", "x2") - reach, reach), bucket(F.greatest("x1", "x2") + reach, reach)))).withColumn("gy", F.explode(F.sequence(bucket(F.least("y1", "y2") - reach, reach), bucket(F.greatest("y1", "y2") + reach, reach))))
    p = points.withColumns({"gx": bucket(F.col("x"), reach), "gy": bucket(F.col("y"), reach), "pid": F.monotonically_increasing_id()})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    near = F.hypot(F.col("x") - F.col("x1") - t * dx, F.col("y") - F.col("y1") - t * dy) <= reach
    return p.join(s, ["gx", "gy"]).where(near).dropDuplicates(["line_id", "pid"]).select("line_id", *points.columns)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(cx, cy, v) from ASCII grid files: six header lines, then rows from the top; no-data values are left out.

    Cells count from the file's lower left corner, in whole cells from the origin.
    """
    text = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*\n\s*").alias("l"))
    key = lambda i: F.split(F.get("l", i), r"\s+")
    head = F.map_from_entries(F.array(*(F.struct(F.lower(F.get(key(i), 0)).alias("k"), F.get(key(i), 1).cast("double").alias("v")) for i in range(6))))
    rows = text.withColumn("h", head).select("h", F.posexplode(F.slice("l", 7, F.size("l"))).alias("r", "line"))
    cells = rows.select("h", "r", F.posexplode(F.split("line", r"\s+")).alias("c", "t")).withColumn("v", F.col("t").cast("double"))
    x0, y0 = F.round(F.try_divide(F.col("h")["xllcorner"], F.col("h")["cellsize"])), F.round(F.try_divide(F.col("h")["yllcorner"], F.col("h")["cellsize"]))
    return cells.where(F.col("v") != F.col("h")["nodata_value"]).select((x0 + F.col("c")).cast("int").alias("cx"), (y0 + F.col("h")["nrows"] - 1 - F.col("r")).cast("int").alias("cy"), "v")


def read_lines(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """(line_id, seq, x, y) from GeoJSON feature collections of LineStrings; other geometries are left out."""
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<double>>>>>>"
    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind).features).alias("f")).where("f.geometry.type = 'LineString'")
    at = f.select(F.col("f.properties")[id_field].cast("bigint").alias("line_id"), F.posexplode("f.geometry.coordinates").alias("i", "p"))
    return at.select("line_id", (F.col("i") + 1).cast("bigint").alias("seq"), F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as one GeoJSON feature for each row of text."""
    point = F.array("x", "y")
    a = lines.groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda s: s.p).alias("c"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("line_id").alias("properties"), F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")).alias("geometry")))
    a.select(feature.alias("value")).write.text(path)
