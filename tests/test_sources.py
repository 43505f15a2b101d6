import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.functions.geometry import Grid
from groundswell.plans import config
from groundswell.sources import clouds, maps, trajectories


def test_pcd_round_trip(spark, tmp_path):
    c = {"x": np.array([1.0, 2.0]), "y": np.array([0.5, -1.0]), "z": np.array([3.0, 4.0]), "intensity": np.array([0.1, 0.2]), "color": np.array([0x010203, 0xFFFFFF])}
    for binary in (True, False):
        path = tmp_path / f"{binary}.pcd"
        path.write_bytes(clouds.pcd_bytes(c, binary))
        rows = clouds.read_pcd(spark, str(path)).orderBy("point_id").collect()
        assert [r["x"] for r in rows] == [1.0, 2.0] and [r["color"] for r in rows] == [0x010203, 0xFFFFFF] and rows[0]["nx"] is None
    assert clouds.read_pcd_metadata(spark, str(path)).first()["width"] == 2
    with pytest.raises(ValueError):
        clouds.pcd_header(b"FIELDS x\nDATA binary_compressed\n")


def test_bin_cut_short(spark, tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(clouds.bin_bytes({k: np.arange(3.0) for k in ("x", "y", "z", "intensity")}) + b"\0" * 7)
    assert clouds.read_kitti(spark, str(path)).count() == 3


@pytest.mark.parametrize("kind,options", [("pcd", {}), ("pcd", {"binary": False, "precision": 9}), ("bin", {"ring": True})])
def test_files_in_pieces_are_the_files_and_cut_anywhere(spark, kind, options):
    points = spark.range(500).select((F.col("id") % 3).cast("int").alias("scan_id"), (500 - F.col("id")).alias("point_id"), *[(F.col("id") * k).cast("double").alias(c) for k, c in enumerate("xyz")], F.lit(0.25).alias("intensity"), F.col("id").cast("int").alias("ring" if kind == "bin" else "color"))
    read = (lambda df: clouds.decoded_bin(df, 5, ring=4)) if kind == "bin" else clouds.decoded_pcd
    named = lambda df: df.withColumnRenamed("scan_id", "path").withColumn("path", F.col("path").cast("string"))
    whole = named(clouds.encoded(points, kind, **options))
    pieces = named(clouds.encoded(points, kind, piece=101, **options))
    files = {r["path"]: r["content"] for r in whole.collect()}
    found = pieces.orderBy("path", "piece").collect()
    assert len(found) > 60 and max(len(r["content"]) for r in found) == 101
    assert files == {k: b"".join(r["content"] for r in found if r["path"] == k) for k in files}
    once, again = (sorted(map(tuple, read(df).collect()), key=lambda r: r[:2]) for df in (whole, pieces))
    assert once == again and len(once) == 500 and [(*r[:2], r[3]) for r in once[:2]] == [("0", 0, 498.0), ("0", 1, 495.0)]
    with pytest.raises(Exception, match="does not follow"):
        read(pieces.where("piece <> 1")).count()


def test_scans_pass_in_batches_not_as_one_value(spark):
    from groundswell.sources import messages, pieces

    p = spark.range(100_000).select(F.lit(1).alias("scan_id"), F.col("id").alias("point_id"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    for made in (clouds.encoded(p, piece=pieces.PIECE), clouds.encoded(p, binary=False, piece=pieces.PIECE), messages.encoded(p, piece=pieces.PIECE)):
        assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()
        size = F.max(F.octet_length("content" if "content" in made.columns else "data"))
        assert made.agg(size).first()[0] == pieces.PIECE and made.count() > 1


def test_trajectories(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("# comment\n0 1 2 3 0 0 0 1\nbad line\n1 2 3 4 0 0 0 1\n")
    poses = trajectories.read_tum(spark, str(path))
    assert [r["tx"] for r in poses.orderBy("ts").collect()] == [1.0, 2.0]
    trajectories.write_kitti(poses, str(tmp_path / "k"))
    back = trajectories.read_kitti(spark, str(tmp_path / "k")).orderBy("ts").collect()
    assert [(r["ts"], r["tz"], r["qw"]) for r in back] == [(0.0, 3.0, 1.0), (1.0, 4.0, 1.0)]


def test_npz_and_png(spark, tmp_path):
    grid = Grid(1.0, 1.5, 0.5)
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 2, 2.0)], "row long, col long, elevation double")
    maps.save_npz(str(tmp_path / "m.npz"), cells, grid)
    back, same, frame = maps.load_npz(spark, str(tmp_path / "m.npz"))
    assert same == grid and frame == "map" and sorted(map(tuple, back.collect())) == [(0, 0, 1.0), (1, 2, 2.0)]
    maps.save_png(str(tmp_path / "m.png"), cells, grid, "elevation")
    assert (tmp_path / "m.png").read_bytes().startswith(b"\x89PNG")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("mapping:\n  mode: GLOBAL\n  sensor: {type: rgbd, a: 0.5}\n  kalman: {min_variance: 0.001}\ntopics: [a, b]\n")
    node = config.load(str(tmp_path / "c.yaml"))
    assert node.mapping.mode == "global" and node.mapping.sensor.a == 0.5 and node.topics == ("a", "b")
    with pytest.raises(ValueError):
        config.of(config.Mapping, {"kalman": {"min_variance": 1.0}})
    with pytest.warns(UserWarning):
        assert config.of(config.Mapping, {"mode": "odd"}).mode == "local"


def test_command_line(spark, tmp_path):
    from groundswell.__main__ import main

    r = np.random.default_rng(1)
    (tmp_path / "in.pcd").write_bytes(clouds.pcd_bytes({"x": r.uniform(-2, 2, 200), "y": r.uniform(-2, 2, 200), "z": r.normal(0, 0.05, 200)}))
    assert main([str(tmp_path / "in.pcd"), str(tmp_path / "out.pcd"), "0.25"]) == 0 and main([]) == 2
    assert 100 < clouds.read_pcd(spark, str(tmp_path / "out.pcd")).count() <= 17 * 17
