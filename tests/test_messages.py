"""Cloud messages field by field, configuration that is mended, colours at known places, and archives in tiles."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.functions.geometry import Grid
from groundswell.functions.sensors import Lidar, Rgbd
from groundswell.operators.estimate import P2, Kalman, Visibility
from groundswell.plans.config import Mapping, Raycasting
from groundswell.sources import clouds, maps, messages as m


def test_field_types_and_points_that_are_not_finite():
    fields = [("x", 0, m.FLOAT32), ("y", 4, m.FLOAT32), ("z", 8, m.FLOAT32), ("intensity", 12, m.UINT16), ("ring", 14, m.UINT8), ("timestamp", 15, m.UINT32), ("rgb", 19, m.FLOAT32), ("label", 23, m.FLOAT32), ("other", 27, m.INT8)]
    fields = [{"name": n, "offset": o, "datatype": t, "count": 1} for n, o, t in fields]
    for big in (False, True):
        e = ">" if big else "<"
        rows = [(1.0, 2.0, 3.0, 300, 7, 5_000_000, 0xFF010203, 9.0), (float("nan"), 0.0, 0.0, 1, 1, 1, 1, 0.0), (4.0, 5.0, 6.0, 2, 1, 10**9, 0x0000FF, 0.0)]
        data = b"".join(struct.pack(e + "fffHBIIfb", *r, 0) for r in rows)
        got = m.message_points(fields, 28, data + b"\0" * 5, 4, big)
        assert got["x"].tolist() == [1.0, 4.0] and got["intensity"].tolist() == [300, 2] and got["ring"].tolist() == [7, 1]
        assert got["t"].tolist() == pytest.approx([0.005, 1.0]) and got["color"].tolist() == [0x010203, 0x0000FF] and got["label"].tolist() == [0, 0]
    with pytest.raises(ValueError):
        m.message_points(fields[:2], 28, data, 3)


def test_messages_keep_every_channel(spark):
    rows = [(1, i, float(i), -1.0, 0.5, 0.25, i, 0.125, 0x010203 + i, 70_000 + i, 0.0, 0.0, 1.0) for i in range(5)]
    p = spark.createDataFrame(rows, "scan_id int, point_id long, x double, y double, z double, intensity double, ring int, t double, color int, label long, nx double, ny double, nz double")
    sent = m.encoded(p, frame_id="lidar", stamp=F.lit(7.5))
    head = sent.first()
    assert (head["frame_id"], head["stamp"], head["width"], head["point_step"], head["row_step"]) == ("lidar", 7.5, 5, 42, 210)
    assert [f["name"] for f in head["fields"]] == ["x", "y", "z", "intensity", "ring", "time", "rgb", "label", "normal_x", "normal_y", "normal_z"]
    back = m.decoded(sent).orderBy("point_id")
    assert [tuple(r) for r in back.select(p.columns).collect()] == rows
    few = m.decoded(m.encoded(p.select("scan_id", "point_id", "x", "y", "z"))).first()
    assert few["intensity"] is None and few["x"] == 0.0
    assert m.decoded(m.encoded(p.limit(0))).count() == 0


def test_messages_in_pieces_are_the_messages(spark):
    p = spark.range(300).select((F.col("id") % 2).cast("int").alias("scan_id"), F.col("id").alias("point_id"), *[F.when(F.col("id") % 7 == 3, float("nan")).otherwise(F.col("id") * k).alias(c) for k, c in enumerate("xyz")], F.col("id").cast("int").alias("ring"))
    whole, pieces = m.encoded(p, stamp=F.col("point_id") * 1.0), m.encoded(p, stamp=F.col("point_id") * 1.0, piece=100)
    found = pieces.orderBy("scan_id", "piece").collect()
    for r in whole.collect():
        own = [q for q in found if q["scan_id"] == r["scan_id"]]
        assert len(own) > 1 and b"".join(q["data"] for q in own) == r["data"] and r["stamp"] == 298.0 + r["scan_id"]
        assert all(q[c] == r[c] for q in own for c in r.asDict() if c != "data")
    once, again = (sorted(tuple(map(str, r)) for r in m.decoded(df).collect()) for df in (whole, pieces))
    assert once == again and len(once) == 300 - 43


def test_grid_message_is_column_by_column(spark):
    grid = Grid(1.0, 1.5, 0.5)
    cells = spark.createDataFrame([(0, 0, 1.0, None), (1, 2, 2.0, 5.0)], "row long, col long, elevation double, variance double")
    got = {r["layer"]: np.frombuffer(r["data"], dtype="<f4") for r in m.grid_message(cells, grid).collect()}
    assert got["elevation"][[0, 5]].tolist() == [1.0, 2.0] and np.isnan(got["elevation"][1:5]).all() and got["variance"][5] == 5.0


def test_tiles_and_damaged_archives(spark, tmp_path):
    grid = Grid(3.0, 2.0, 0.5, 10.0, -4.0)
    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(6) for j in range(4) if (i, j) != (2, 2)], "row long, col long, elevation double")
    with pytest.warns(UserWarning):
        maps.save_npz(f"{tmp_path}/m", cells, grid, ["elevation", "gone"], "odom", tile=4)
    back, same, frame = maps.load_npz(spark, f"{tmp_path}/m")
    assert same == grid and frame == "odom" and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    whole = maps.archive({"version": 1, "resolution": 1.0, "position": [0, 0], "size": [2, 2], "start_index": [1, 0]}, {"a": np.arange(4, dtype=np.float32).reshape(2, 2), "b": np.zeros((3, 3), np.float32)})
    with pytest.warns(UserWarning):
        meta, layers = maps.opened(whole)
    assert list(layers) == ["a"] and layers["a"].tolist() == [[2, 3], [0, 1]]
    for bad in ({"version": 2, "size": [1, 1]}, {"version": 1, "size": [9, 9]}):
        with pytest.raises(ValueError), pytest.warns(UserWarning) if bad["version"] == 1 else __import__("contextlib").nullcontext():
            maps.opened(maps.archive(bad, {"a": np.zeros((2, 2), np.float32)}))


def test_pictures_show_the_buffer_or_the_world(spark):
    import zlib

    grid = Grid(1.0, 1.0, 0.5)
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "row long, col long, elevation double")

    def pixels(**options):
        raw = maps.encoded_png(cells, grid, "elevation", (1, 0), colormap="grayscale", normalize="min_max", **options).first()["content"]
        at = raw.index(b"IDAT")
        n = int.from_bytes(raw[at - 4 : at], "big")
        return np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + n]), np.uint8).reshape(2, 9)[:, 1:].reshape(2, 2, 4)

    world, buffer = pixels(align_to_world=True), pixels()
    assert world[0, 0].tolist() == [0, 0, 0, 255] and world[1, 1].tolist() == [255, 255, 255, 255] and world[0, 1, 3] == 0
    assert buffer[1, 0].tolist() == [0, 0, 0, 255] and buffer[0, 1].tolist() == [255, 255, 255, 255]


def test_odd_settings_are_mended_and_contradictions_raise():
    with pytest.warns(UserWarning):
        got = Mapping(kalman=Kalman(0.0, 1e-2, -1.0), p2=P2((-0.1, 0.2, 0.5, 0.8, 1.4), 9), sensor=Lidar(-1.0, -2.0), raycasting=Raycasting(True, Visibility(0.0, 0.0, 0.0, 0.0, 0.5)))
    assert got.kalman == Kalman(1e-4, 1e-2, 0.0) and got.p2 == P2((0.0, 0.2, 0.5, 0.8, 1.0), 4) and got.sensor == Lidar(0.02, 0.0) and got.raycasting.visibility == Visibility()
    with pytest.warns(UserWarning):
        assert Mapping(sensor=Rgbd(a=-1.0, lateral=-1.0)).sensor == Rgbd(a=0.0, lateral=0.0)
    assert Raycasting(False, Visibility(threshold=0.0)).visibility.threshold == 0.0
    with pytest.raises(ValueError):
        P2((0.5, 0.2, 0.5, 0.8, 1.0))


def test_columns_of_another_library(spark):
    got = clouds.from_columns(spark, {"x": np.arange(3.0), "y": np.zeros(3), "z": np.ones(3), "ring": np.arange(3)})
    assert [tuple(r) for r in got.orderBy("point_id").collect()] == [(i, float(i), 0.0, 1.0, i) for i in range(3)]
