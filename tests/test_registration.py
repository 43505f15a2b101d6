import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.functions.geometry import Rigid, transformed
from groundswell.operators import normals, register, spatial


def test_point_to_point_recovers_a_known_motion(spark):
    p = np.random.default_rng(7).uniform(-3, 3, (120, 3))
    target = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double")
    motion = Rigid.from_rpy(0.0, 0.0, 0.02, (0.05, -0.03, 0.02))
    got = register.align(transformed(target, motion), target, settings=register.Settings(most_iterations=6))
    assert np.allclose(got.transform, np.linalg.inv(motion.matrix), atol=1e-6) and got.fitness == 1.0


def test_too_few_points_give_the_guess(spark):
    few = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    got = register.align(few, few)
    assert not got.converged and np.allclose(got.transform, np.eye(4)) and got.fitness == 0.0
    with pytest.raises(ValueError):
        register.align(few, few, "plane")


def bumpy(spark, n=400):
    rng = np.random.default_rng(11)
    xy = rng.uniform(-3, 3, (n, 2))
    z = 0.4 * np.sin(1.3 * xy[:, 0]) + 0.3 * np.cos(1.7 * xy[:, 1])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.c_[xy, z])], "point_id long, x double, y double, z double")


@pytest.mark.parametrize("method", ["plane", "gicp", "vgicp", "adaptive", "none", "own"])
def test_each_method_recovers_a_known_motion(spark, method):
    target = bumpy(spark)
    motion = Rigid.from_rpy(0.01, -0.01, 0.03, (0.04, -0.03, 0.02))
    source = transformed(target, motion)
    options = {"adaptive": {"solver": register.Adaptive()}, "none": {"solver": register.Damped(0.0)}}.get(method, {})
    if method in ("plane", "gicp", "vgicp"):
        source, target = (normals.with_normals(c, 10, covariances=True) for c in (source, target))
        found = register.align(source, target, method, settings=register.Settings(most_iterations=15, voxel=0.8))
    elif method == "own":  # half of the points weigh nothing
        weight = lambda pairs, s: register.system(register.cross_jacobian(), [F.col(a) - F.col(b) for a, b in zip("xyz", ("qx", "qy", "qz"), strict=True)], None, F.when(F.col("point_id") % 2 == 0, 1.0).otherwise(0.0))
        found = register.align(source, target, register.Factor(lambda here, t, s: register.correspondences(here, t, 0.5), weight))
    else:
        found = register.align(source, target, settings=register.Settings(most_iterations=15), **options)
    apart = found.transform @ motion.matrix
    assert np.abs(apart - np.eye(4)).max() < (0.02 if method == "vgicp" else 1e-3) and found.fitness > 0.95


def test_missing_channels_raise_and_few_pairs_give_the_guess(spark):
    p = bumpy(spark, 12)
    for method in ("plane", "gicp", "vgicp"):
        with pytest.raises(ValueError):
            register.align(p, p, method)
    far = p.withColumn("x", F.col("x") + 1000)
    got = register.align(far, p)
    assert not got.converged and (got.transform == np.eye(4)).all() and got.fitness == 0.0


def test_normals_of_planes_and_lone_points(spark):
    rows = [(i, 0.5 * (i % 5), 0.5 * (i // 5), 0.0) for i in range(25)] + [(99, 50.0, 50.0, 50.0)]
    p = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    got = {r["point_id"]: r for r in normals.with_normals(p, None, 0.8, (0.0, 0.0, 5.0), covariances=True).collect()}
    assert all(abs(got[i]["nz"] - 1) < 1e-9 for i in range(25)) and got[99]["nz"] == 0.0
    assert got[0]["czz"] == pytest.approx(1e-3) and got[0]["cxx"] == pytest.approx(1.0) and got[99]["czz"] == 1.0
    odd = normals.with_normals(p, 5, covariances=True).withColumn("cxy", F.when(F.col("point_id") == 3, float("nan")).otherwise(F.col("cxy")))
    mended = {r["point_id"]: r for r in normals.mended_covariances(odd).collect()}
    assert (mended[3]["cxx"], mended[3]["cxy"]) == (1e-3, 0.0) and mended[4]["cxx"] == pytest.approx(1.0)


def crowded(spark, seed, n):
    """Points of which half lie in a hundredth of the room, some at one place, some at the corners of a lattice."""
    rng = np.random.default_rng(seed)
    p = np.r_[rng.normal(0, 0.05, (n // 2, 3)), rng.normal(0, 2.0, (n // 2, 3)), np.full((40, 3), 0.25), np.stack(np.meshgrid(*[[-1.0, -0.5, 0.0, 0.5]] * 3), -1).reshape(-1, 3)]
    order = rng.permutation(len(p))
    return p, order, spark.createDataFrame([(int(i), *map(float, v)) for i, v in zip(order, p, strict=True)], "point_id long, x double, y double, z double")


def test_nearest_points_are_exact_and_few_are_looked_at(spark):
    p, ids, target = crowded(spark, 3, 1500)
    q, own, source = crowded(spark, 4, 1500)
    d2 = sum((q[:, None, k] - p[None, :, k]) ** 2 for k in range(3))
    first = {int(i): int(ids[np.lexsort((ids, row))[0]]) for i, row in zip(own, d2, strict=True) if row.min() < 1.0}
    got = spatial.closest(source, target, 1.0)
    assert {r["src_id"]: r["dst_id"] for r in got.collect()} == first and len(first) < len(q)
    assert spatial.candidates(source, target, 1.0).count() < (d2 < 1).sum() / 5  # all pairs within the distance were made before
    want = {(int(i), r + 1, int(ids[j])) for i, row in zip(own, d2, strict=True) for r, j in enumerate(np.lexsort((ids, row))[:7])}
    assert {(r["src_id"], r["rank"], r["dst_id"]) for r in spatial.nearest(source, target, 7).collect()} == want
    bounded = {w for w in want if d2[list(own).index(w[0]), list(ids).index(w[2])] <= 0.09}
    assert {(r["src_id"], r["rank"], r["dst_id"]) for r in spatial.nearest(source, target, 7, max_distance=0.3).collect()} == bounded
    begun = spatial.begun(source, target, 7, 1.0).groupBy("level").count().collect()
    assert max(r["level"] for r in begun) >= 3 and min(r["level"] for r in begun) == 0
