"""The whole mapping plan on small scans."""

import pytest
from pyspark.sql import functions as F

from groundswell.functions.sensors import Constant
from groundswell.plans.config import Mapping, Postprocess
from groundswell.plans.mapper import Mapper, postprocessed, window_spans

POSE = "tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def providers(spark, places):
    still = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    extrinsics = spark.createDataFrame([("lidar", *still)], f"frame_id string, {POSE}")
    poses = spark.createDataFrame([(float(k), float(x), *still[1:]) for k, x in enumerate(places)], f"ts double, {POSE}")
    return extrinsics, poses


def scans(spark, rows):
    """rows: scan, x and y in the sensor's frame, z."""
    data = [(i, s, float(s), f, x, y, z, 0.5) for i, (s, f, x, y, z) in enumerate(rows)]
    return spark.createDataFrame(data, "point_id long, scan_id long, scan_ts double, frame_id string, x double, y double, z double, intensity double")


def test_window_that_leaves_forgets(spark):
    places = [0, 0, 100, 0]
    rows = [(0, "lidar", 0.2, 0.2, 1.0), (1, "lidar", 0.2, 0.2, 1.0), (2, "lidar", 0.2, 0.2, 5.0), (3, "lidar", 0.2, 0.2, 2.0), (3, "unknown", 0.2, 0.2, 9.0)]
    p = scans(spark, rows)
    config = Mapping(sensor=Constant(), length_x=400.0, length_y=400.0, resolution=1.0)
    whole = Mapper(config).with_mode("global").with_providers(*providers(spark, places), None).mapped(p)
    got = {(r["row"], r["col"]): r for r in whole.collect()}
    assert got[199, 199]["n_points"] == 3 and got[99, 199]["n_points"] == 1 and got[199, 199]["elevation_max"] == 2.0
    small = Mapper(Mapping(mode="local", sensor=Constant(), length_x=400.0, length_y=400.0, resolution=1.0)).with_providers(*providers(spark, places), None)
    stays = {(r["row"], r["col"]): r["n_points"] for r in small.mapped(p).collect()}
    assert stays[199, 199] == 3  # a window of 400 m never leaves the cell
    prepared = small.preprocessed(p)
    cells = small.facts(prepared).select("scan_id", "row", "col", F.col("min_z").alias("z"), F.lit(0.01).alias("variance"))
    narrow = Mapper(Mapping(mode="local", sensor=Constant(), length_x=40.0, length_y=40.0, resolution=1.0)).with_providers(*providers(spark, places), None)
    cells = cells.withColumns({"row": F.col("row") - 180, "col": F.col("col") - 180})  # the origin's cell has number 19 here
    flags = {(r["scan_id"], r["row"]): r["reset"] for r in narrow.windowed(cells, prepared).collect()}
    assert flags[0, 19] is False and flags[1, 19] is False and flags[3, 19] is True and flags[4, 19] is False
    assert flags[2, -81] is False and flags[4, -81] is True
    kept = {(r["row"], r["col"]): r["n_points"] for r in narrow.mapped(p).collect()}
    assert kept == {(19, 19): 1}


def test_spans_are_the_bounds(spark):
    at = spark.createDataFrame([(i + 1, v, -v) for i, v in enumerate([3, 1, 4, 1, 5])], "nth int, wr long, wc long")
    got = {(r["power"], r["nth"]): (r["lo_r"], r["hi_r"]) for r in window_spans(at).collect()}
    assert got[2, 1] == (1, 4) and got[1, 4] == (1, 5) and got[0, 3] == (4, 4) and (2, 3) not in got


def test_stale_scans_are_left_out(spark):
    p = scans(spark, [(0, "lidar", 0.2, 0.2, 1.0), (7, "lidar", 0.2, 0.2, 3.0)])
    config = Mapping(mode="global", sensor=Constant(), resolution=1.0)
    got = Mapper(config).with_providers(*providers(spark, [0, 0]), 0.1).mapped(p).collect()
    assert [r["elevation"] for r in got] == [1.0]


def test_raycasting_and_p2_modes(spark):
    p = scans(spark, [(k, "lidar", 1.2, 0.2, -1.0) for k in range(6)])
    base = Mapper(Mapping(mode="global", sensor=Constant(), resolution=0.5))
    assert base.with_raycasting().mapped(p).first()["n_points"] == 6
    assert base.with_estimator("p2_quantile").mapped(p).first()["elevation"] == pytest.approx(-1.0)


def test_postprocessing_keeps_layers(spark):
    cells = spark.createDataFrame([(i, j, 1.0, 0.9, 1.1) for i in range(4) for j in range(4) if (i, j) != (1, 1)], "row long, col long, elevation double, lower_bound double, upper_bound double")
    grid = Mapper(Mapping(length_x=2.0, length_y=2.0, resolution=0.5)).grid
    out = postprocessed(cells, grid, Postprocess(inpaint=True, fuse=True, features=True, feature_radius=1.0, fusion_radius=0.6))
    assert out.count() == 16 and {"slope", "lower_bound", "step"} <= set(out.columns)
