import json
import math
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wayfold.functions import scalar as S
from wayfold.operators import lines as L
from wayfold.operators import network as N
from wayfold.operators import raster as R
from wayfold.operators import conductivity as C
from wayfold.operators.roads import default_rows, measure_roads
from wayfold.operators.spatial import boxes_to_edges, crossings, in_polygons
from wayfold.params import DEFAULTS
from wayfold.sources import tables as T
from wayfold.streaming.grid import running_cells


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


LINE = "line_id long, seq long, x double, y double"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_activations_at_their_bounds(spark):
    x = [F.lit(v).cast("double") for v in (0.5, 1.0, 2.5, 4.0, 9.0, None)]
    assert one(spark, *(S.activation_linear(v, 1, 4).alias(f"a{i}") for i, v in enumerate(x))) == (0, 0, 0.5, 1, 1, None)
    assert one(spark, *(S.activation_linear(v, 1, 4, False).alias(f"a{i}") for i, v in enumerate(x))) == (1, 1, 0.5, 0, 0, None)
    assert one(spark, *(S.activation_steps(v, (1, 4)).alias(f"a{i}") for i, v in enumerate(x))) == (0, 0.5, 0.5, 1, 1, 0)
    assert one(spark, *(S.activation_steps(v, (4,), False).alias(f"a{i}") for i, v in enumerate(x))) == (1, 1, 1, 0, 0, 0)


def test_classes_and_angles(spark):
    assert one(spark, *(S.road_class(F.lit(v).cast("double")).alias(str(i)) for i, v in enumerate((0, 24.9, 25, 50, 75, 100, None)))) == (4, 4, 3, 2, 1, 1, None)
    assert one(spark, S.angle_gap(F.lit(350.0), F.lit(10.0)).alias("a"), S.angle_gap(F.lit(-170.0), F.lit(170.0)).alias("b"), S.road_score(*(F.lit(v).cast("double") for v in (10, 5, 0.5, 75))).alias("c")) == (20, 20, 100)


def test_tee_junction(spark):
    v = frame(spark, [(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (2, 1, 10.0, 0.0), (2, 2, 20.0, 0.0), (3, 1, 12.0, 1.0), (3, 2, 12.0, 30.0)], LINE)
    got = {(r.nb_connected, r.nb_unconnected) for r in N.missing_junctions(v).collect()}
    assert got == {(2, 1)}
    lines, met = N.snap_simple(v, 3)
    ends = {(r.x, r.y) for r in L.ends(lines).where("x between 9 and 13 and y < 5").collect()}
    assert len(ends) == 1 and met.count() == 0


def test_crossing_pair(spark):
    v = frame(spark, [(1, 1, 0.0, 0.0), (1, 2, 50.0, 50.0), (2, 1, 0.0, 50.0), (2, 2, 50.0, 0.0), (3, 1, 50.0, 50.0), (3, 2, 90.0, 50.0)], LINE)
    assert [(r.a, r.b, r.x, r.y) for r in crossings(L.segments(v)).collect()] == [(1, 2, 25.0, 25.0)]


def test_in_polygons(spark):
    p = frame(spark, [(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 5.0, 25.0)], "pid long, px double, py double")
    e = boxes_to_edges(frame(spark, [(7, 0.0, 0.0, 10.0, 30.0)], "gid int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.pid, r.gid) for r in in_polygons(p, e).collect()) == [(1, 7), (3, 7)]


def test_split_and_substring_keep_length(spark):
    v = frame(spark, [(1, i, float(i * 3), float((i * 7) % 5)) for i in range(1, 9)], LINE)
    total = L.lengths(v).first().length
    parts = L.split_at(v, L.lengths(v).select("line_id", (F.col("length") * 0.4).alias("m")))
    both = parts.select((F.col("part")).cast("long").alias("line_id"), "seq", "x", "y")
    assert math.isclose(sum(r.length for r in L.lengths(both).collect()), total)
    assert math.isclose(L.lengths(L.substring(v, F.lit(0.25), F.lit(0.75))).first().length, total / 2)


def test_slope_of_a_plane(spark):
    cells = spark.range(100).select((F.col("id") % 10).cast("int").alias("cx"), (F.col("id") / 10).cast("int").alias("cy")).withColumn("v", F.col("cx").cast("double"))
    got = {round(r.v, 6) for r in R.slope(cells).where("v is not null").collect()}
    assert got == {45.0} and R.slope(cells).where("v is null").count() == 36


def test_default_rows(spark):
    r = default_rows(frame(spark, [(1, "a", 5), (2, "b", 6)], "line_id long, name string, class int"), F.col("line_id") == 2)
    assert [tuple(x) for x in r.orderBy("line_id").collect()] == [(1, "a", None, None, None, None, None, None, None, 0), (2, "b", 0, 0, 100, 0, None, 0, 0, 4)]


def test_flat_strip_is_measured(spark):
    """A flat road 8 wide between slopes, without plants: found where it is, of a good class."""
    rows = []
    for i in range(0, 130):
        for j in range(0, 61):
            y = j / 1.5
            off = abs(y - 20)
            z = 0.0 if off <= 4 else (off - 4) * 0.4
            rows.append((float(i) + 0.3, y + 0.1, z, 100, 1, 2, 0))
    p = frame(spark, rows, "x double, y double, z double, intensity int, psid int, cls int, angle int")
    v = frame(spark, [(1, 1, 12.0, 20.1), (1, 2, 118.0, 20.1)], LINE)
    moved = frame(spark, [(1, 1, 12.0, 23.1), (1, 2, 118.0, 23.1)], LINE)
    found, at, failed = measure_roads(p, moved, DEFAULTS)
    assert failed.count() == 0 and found.first().CONDUCTIVITY > 0.5
    assert found.first().CLASS <= 2 and all(17 <= q.y <= 23 for q in at.collect())
    roads, lines, errors = measure_roads(p, v, replace(DEFAULTS, confidence=1))
    r = roads.first()
    assert 6 <= r.ROADWIDTH <= 10 and r.CLASS == 1 and r.SINUOSITY == 1 and errors.count() == 0 and lines.count() > 0


    v = frame(spark, [(-5, 1, 12.0, 20.1), (-5, 2, 118.0, 20.1), (10**12, 1, 12.0, 20.1), (10**12, 2, 70.0, 20.1)], LINE)
    pieces = replace(DEFAULTS, confidence=1, extraction=replace(DEFAULTS.extraction, road_max_len=52))
    roads, lines, _ = measure_roads(p, v, pieces)
    assert sorted((r.line_id, r.CLASS) for r in roads.collect()) == [(-5, 1), (10**12, 1)]
    xs = [r.x for r in lines.where("line_id = -5").orderBy("seq").collect()]
    assert xs == sorted(xs) and xs[0] == 12 and xs[-1] == 118


def test_edges_hardly_depend_on_tiles(spark):
    cells = spark.range(128 * 48).select((F.col("id") % 128).cast("int").alias("cx"), F.floor(F.col("id") / 128).cast("int").alias("cy"))
    cells = cells.withColumn("v", (F.col("cx") / 128 + F.pmod(F.xxhash64("cx", "cy"), F.lit(5)) / 20) / 1.2)
    one, other = (C.edge_enhanced(cells, tile=t, halo=32).withColumnRenamed("v", f"v{t}") for t in (64, 256))
    far = one.join(other, ["cx", "cy"]).select(F.avg(F.abs(F.col("v64") - F.col("v256"))).alias("mean"), F.max(F.abs(F.col("v64") - F.col("v256"))).alias("most"), F.count("*").alias("n")).first()
    assert far.n == 128 * 48 and far.mean < 0.01 and far.most < 0.1, far


def test_short_road_is_class_0(spark):
    p = frame(spark, [(1.0, 1.0, 0.0, 1, 1, 2, 0)], "x double, y double, z double, intensity int, psid int, cls int, angle int")
    v = frame(spark, [(1, 1, 0.0, 0.0), (1, 2, 5.0, 0.0)], LINE)
    roads, lines, _ = measure_roads(p, v, replace(DEFAULTS, confidence=1))
    assert roads.first().CLASS == 0 and lines.count() == 2


def test_tiles_prune_and_refuse(spark, tmp_path):
    p = frame(spark, [(float(i), float(i % 7), 1.0) for i in range(1000)], "x double, y double, z double")
    path = f"{tmp_path}/tiles"
    T.write_tiles(p, path, 100)
    part = T.read_tiles(spark, path, (150, 0, 249, 10), 100)
    assert part.count() == 100 and set(part.columns) == {"x", "y", "z"}
    assert "PartitionFilters: [isnotnull(tile_x" in part._jdf.queryExecution().toString().replace("\n", " ") or "tile_x" in part._jdf.queryExecution().toString()
    p.write.parquet(f"{tmp_path}/flat")
    with pytest.raises(ValueError):
        T.read_tiles(spark, f"{tmp_path}/flat")


def test_clip(spark):
    p = frame(spark, [(float(i), 0.5) for i in range(20)], "x double, y double")
    v = frame(spark, [(4, 1, 3.0, 0.0), (4, 2, 6.0, 0.0), (4, 3, 9.0, 0.0)], LINE)
    got = T.clip_to_lines(p, v, 1).collect()
    assert sorted(r.x for r in got) == [float(i) for i in range(3, 10)]


def test_grid_and_lines_files(spark, tmp_path):
    with open(f"{tmp_path}/g.asc", "w") as f:
        f.write("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    assert sorted((r.cx, r.cy, r.v) for r in T.read_grid(spark, f"{tmp_path}/g.asc").collect()) == [(5, 10, 4.0), (5, 11, 1.0), (6, 11, 2.0), (7, 10, 6.0), (7, 11, 3.0)]
    v = frame(spark, [(1, 1, 0.5, 0.0), (1, 2, 1.0, 2.0)], LINE)
    T.write_lines(v, f"{tmp_path}/out")
    features = [json.loads(x) for f in os.listdir(f"{tmp_path}/out") if f.startswith("part") for x in open(f"{tmp_path}/out/{f}")]
    with open(f"{tmp_path}/l.json", "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    assert sorted(map(tuple, T.read_lines(spark, f"{tmp_path}/l.json", "line_id").collect())) == [(1, 1, 0.5, 0.0), (1, 2, 1.0, 2.0)]


def test_stream(spark, tmp_path):
    p = frame(spark, [(0.5, 0.5, 1.0), (0.6, 0.2, 3.0), (1.5, 0.5, 2.0)], "x double, y double, z double")
    p.write.parquet(f"{tmp_path}/in")
    q = running_cells(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in"), 1).writeStream.outputMode("complete").format("memory").queryName("cells_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from cells_out").collect())) == [(0, 0, 2, 1.0, 3.0), (1, 0, 1, 2.0, 2.0)]


def test_guards_name_what_is_wrong(spark):
    from wayfold.operators import checks as K

    with pytest.raises(ValueError, match="road_buffer"):
        K.need_parameters(replace(DEFAULTS, extraction=replace(DEFAULTS.extraction, road_buffer=20)))
    with pytest.raises(ValueError, match="confidence"):
        K.need_parameters(replace(DEFAULTS, confidence=2))
    K.need_parameters(DEFAULTS)
    with pytest.raises(ValueError, match="not 1.5"):
        K.need_resolution(1.5, 1, "a terrain")
    with pytest.raises(ValueError, match="smaller than two cells"):
        K.need_tiles(1, 1)
    K.need_tiles(0, 1)
    v = frame(spark, [(1, 1, 0.0, 0.0), (1, 2, None, 1.0), (2, 1, 0.0, 0.0), (3, 1, 0.0, 0.0), (3, 1, 1.0, 0.0), (4, 1, 0.0, 0.0), (4, 2, 5.0, 0.0)], LINE)
    assert sorted(tuple(r) for r in K.faulty_lines(v).collect()) == [(1, "place unknown"), (2, "one vertex"), (3, "place number twice")]
    with pytest.raises(ValueError, match="seq not found"):
        measure_roads(frame(spark, [], "x double, y double, z double, cls int"), v.drop("seq"))


def test_locate_at_ends_repeats_and_off_the_line(spark):
    v = frame(spark, [(1, 1, 0.0, 0.0), (1, 2, 4.0, 0.0), (1, 3, 4.0, 0.0), (1, 4, 4.0, 3.0), (1, 5, 4.0, 3.0)], LINE)
    at = frame(spark, [(1, 0, 0.0), (1, 1, 4.0), (1, 2, 5.0), (1, 3, 7.0), (1, 4, 8.0), (1, 5, -1.0), (1, 6, None), (2, 0, 1.0)], "line_id long, k int, m double")
    assert sorted((r.k, r.x, r.y) for r in L.locate(v, at).collect()) == [(0, 0, 0), (1, 4, 0), (2, 4, 1), (3, 4, 3)]
    assert sorted((r.k, r.x, r.y) for r in L.locate(v, at, from_end=True).collect()) == [(0, 4, 3), (1, 3, 0), (2, 2, 0), (3, 0, 0)]
    with pytest.raises(Exception, match="lies off its line"):
        L.locate(v, at, strict=True).collect()


def test_cropped_lines(spark):
    v = frame(spark, [(1, 1, -5.0, 5.0), (1, 2, 15.0, 5.0), (2, 1, 0.0, 20.0), (2, 2, 5.0, 20.0), (3, 1, 2.0, 2.0), (3, 2, 2.0, 30.0), (4, 1, -5.0, 5.0), (4, 2, 5.0, 15.0)], LINE)
    assert sorted(tuple(r) for r in L.cropped(v, 0, 0, 10, 10).collect()) == [(1, 1, 0, 5, 10, 5), (3, 1, 2, 2, 2, 10)]


def test_near_closed_roads_have_a_smaller_buffer(spark):
    from wayfold.operators.paths import masked

    v = frame(spark, [(1, 1, 0.0, 0.0), (1, 2, 100.0, 0.0), (1, 3, 100.0, 45.0), (1, 4, 0.0, 45.0), (2, 1, 0.0, 0.0), (2, 2, 400.0, 0.0)], LINE)
    cells = spark.range(0, 40_000).selectExpr("cast(id % 200 as int) as cx", "cast(floor(id / 200) as int) - 100 as cy", "1.0D as sigma")
    far = {r.line_id: r.lo for r in masked(cells, v).groupBy("line_id").agg(F.min((F.col("cy") + 0.5) * 2).alias("lo")).collect()}
    assert far == {1: -21.0, 2: -79.0}


def test_loops_are_cut(spark):
    v = frame(spark, [(1, 1, 5.0, 5.0), (1, 2, 65.0, 5.0), (1, 3, 65.0, 65.0), (1, 4, 5.0, 65.0), (1, 5, 5.0, 6.0)], LINE)
    p = spark.range(0, 19_600).selectExpr("(id % 140) / 2 as x", "floor(id / 140) / 2D as y", "0D as z", "2 as cls", "1 as psid", "0 as angle")
    roads, lines, errors = measure_roads(p, v, replace(DEFAULTS, confidence=1))
    (r,) = roads.collect()
    assert r.line_id == 1 and r.CLASS >= 1 and r.SINUOSITY < 2 and errors.count() == 0
