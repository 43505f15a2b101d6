import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.functions.geometry import Grid
from groundswell.operators import asof, estimate, filters, raster, raycast, segment, spatial, stencil, voxel

XYZ = "point_id long, x double, y double, z double"


@pytest.fixture(scope="module")
def lattice(spark):
    rows = [(9 * i + 3 * j + k, float(i), float(j), float(k)) for i in range(3) for j in range(3) for k in range(3)]
    return spark.createDataFrame(rows, XYZ)


def test_crops_count_and_skip_nan(spark, lattice):
    assert filters.crop_box(lattice, (0, 0, 0), (1, 1, 1)).count() == 8
    assert filters.crop_box(lattice, (0, 0, 0), (1, 1, 1), outside=True).count() == 19
    assert filters.crop_range(lattice, 0.0, 1.0).count() == 4
    odd = spark.createDataFrame([(1, float("nan"), 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("inf"), 0.0, 0.0), (4, 1.0, 1.0, 1.0)], XYZ)
    assert [r["point_id"] for r in filters.remove_invalid(odd).collect()] == [4]
    assert sorted(r["point_id"] for r in filters.crop_axis(odd, "x", -1, 0.5, outside=True).collect()) == [3, 4]


def test_voxel_choices(spark):
    p = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 0.5, 0.5, 0.4), (3, 0.9, 0.9, 0.9)], XYZ)
    assert voxel.voxel_grid(p, 1.0, "nearest").first()["point_id"] == 2
    assert voxel.voxel_grid(p, 1.0, "any").first()["point_id"] == 1
    assert voxel.voxel_grid(p, 1.0).first()["x"] == pytest.approx(0.5)
    assert voxel.voxel_grid(p.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        voxel.voxel_grid(p, 0.0)


def test_raster_round_trip(spark):
    grid = Grid(10, 10, 0.5)
    p = spark.createDataFrame([(1, 0.1, 0.1, 1.0), (2, 0.2, 0.2, 3.0), (3, 99.0, 0.0, 1.0)], XYZ)
    cells = raster.from_points(p, grid, "mean")
    r = cells.first()
    assert (r["elevation"], r["n_points"], r["variance"]) == (2.0, 2, 2.0)
    back = raster.to_points(cells, grid).first()
    assert (back["x"], back["y"]) == (0.25, 0.25)
    assert raster.elevation_at(cells, grid, 0.1, 0.1).count() == 1
    assert raster.elevation_at(cells, grid, 3.0, 3.0).count() == 0


def kalman(zs, r=0.01, low=1e-4, high=1e-2):
    x, p = zs[0], r
    for z in zs[1:]:
        k = p / (p + r)
        x, p = x + k * (z - x), min(max((1 - k) * p, low), high)
    return x


def test_fold_is_the_loop_and_splits(spark):
    zs = [5.0, 3.0, 1.0, 4.0, 2.0]
    rows = [(i, 0, 0, z, 0.01) for i, z in enumerate(zs)]
    df = spark.createDataFrame(rows, "scan_id long, row long, col long, z double, variance double")
    one = estimate.layers(estimate.fold(df)).first()
    assert one["elevation"] == pytest.approx(kalman(zs))
    assert one["variance"] == pytest.approx(np.var(zs, ddof=1))
    first = estimate.fold(df.where("scan_id < 2"))
    rest = estimate.fold(df.where("scan_id >= 2").join(first, ["row", "col"]), start="state")
    assert estimate.layers(rest).first()["elevation"] == pytest.approx(one["elevation"])


def test_p2_follows_the_quantiles():
    zs = np.random.default_rng(42).normal(5, 1, 1000)
    q = estimate.p2_markers([zs, zs[:3]], estimate.P2())
    assert (np.diff(q[0]) >= 0).all() and abs(q[0][2] - 5) < 0.2
    assert np.isnan(q[1][3])


def test_hole_is_filled(spark):
    cells = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3) if (i, j) != (1, 1)], "row long, col long, elevation double")
    out = stencil.inpainted(cells, Grid(1.5, 1.5, 0.5), 1)
    assert out.where("row = 1 AND col = 1").first()["elevation"] == 1.0
    assert out.count() == 9


def test_slope_of_a_ramp(spark):
    cells = spark.createDataFrame([(i, j, 0.25 * i) for i in range(7) for j in range(7)], "row long, col long, elevation double")
    got = stencil.terrain_features(cells, 0.5, radius=1.0).where("row = 3 AND col = 3").first()
    assert got["slope"] == pytest.approx(math.degrees(math.atan(0.5)), abs=1e-6)
    assert got["roughness"] == pytest.approx(0.0, abs=1e-6)


def test_ghost_is_cleared(spark):
    rows = [(k, 0, 0, 10.0 if k == 0 else None, 0.01, 0 if k else 1, None if k == 0 else 2.5) for k in range(12)]
    df = spark.createDataFrame(rows, "scan_id long, row long, col long, z double, variance double, hits long, ray double")
    out = estimate.layers(estimate.fold(df, visibility=estimate.Visibility())).first()
    assert out["elevation"] is None and out["ghost_removal"] == 1.0


def test_rays_cross_the_row(spark):
    grid = Grid(10, 10, 0.5)
    ray, row, col, h = raycast.walked(np.array([[0.0, 0.1, 5.0]]), np.array([[4.0, 0.1, 0.0]]), grid)
    assert len(set(col.tolist())) == 1 and (np.diff(row) == -1).all() and (np.diff(h) < 0).all()
    assert len(raycast.walked(np.zeros((1, 3)), np.zeros((1, 3)), grid)[0]) == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(42)
    p = rng.uniform(-3, 3, (80, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], XYZ)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    got = {(r["src_id"], r["dst_id"]) for r in spatial.within(df, df, 1.0).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d2 <= 1.0)), strict=True))
    near = {(r["src_id"], r["rank"]): r["dst_id"] for r in spatial.nearest(df, df, 4, 0.3).collect()}
    assert near == {(i, k + 1): int(j) for i in range(80) for k, j in enumerate(np.argsort(d2[i])[:4])}


def test_clusters(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 0.1, (12, 3)), rng.normal(5, 0.1, (8, 3)), [[50, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], XYZ)
    got = segment.euclidean_clusters(df, 1.0, 3).groupBy("cluster_id").count().orderBy("cluster_id").collect()
    assert [tuple(r) for r in got] == [(0, 12), (1, 8)]


def test_plane_is_found(spark):
    rng = np.random.default_rng(2)
    flat = [(i, *map(float, rng.uniform(-5, 5, 2)), float(rng.uniform(-0.01, 0.01))) for i in range(60)]
    df = spark.createDataFrame(flat + [(100 + i, 0.0, 0.0, 3.0 + i) for i in range(5)], XYZ)
    plane, inliers, stats = segment.segment_plane(df, 0.1, 50)
    assert abs(plane[2]) > 0.99 and inliers.count() == 60 and stats["fitness"] == pytest.approx(60 / 65)
    assert segment.segment_plane(df.limit(2))[0] is None


def test_poses_between(spark):
    poses = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (10.0, 10.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    q = spark.createDataFrame([(-1.0, 1), (2.5, 2), (11.0, 3)], "ts double, id long")
    got = {r["id"]: r for r in asof.poses_at(q, poses).collect()}
    assert [got[k]["tx"] for k in (1, 2, 3)] == [0.0, 2.5, 10.0]
    assert got[2]["qz"] == pytest.approx(math.sin(math.pi / 8))
    assert {r["id"] for r in asof.poses_at(q, poses, clamp=False).collect()} == {2}
    assert {r["id"] for r in asof.poses_at(q, poses, most_stale=1.5).collect()} == {1, 3}
