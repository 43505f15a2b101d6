import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.functions import geometry as g


def test_exp_and_log_are_inverse():
    rng = np.random.default_rng(0)
    for _ in range(50):
        xi = rng.normal(size=6)
        xi[3:] *= min(1.0, 3.0 / np.linalg.norm(xi[3:]))
        assert np.allclose(g.se3_log(g.se3_exp(xi)), xi, atol=1e-9)
    assert np.allclose(g.se3_exp(np.zeros(6)), np.eye(4))


def test_quaternion_and_angles_agree():
    a = g.Rigid.from_rpy(0, 0, math.pi / 3)
    b = g.Rigid.from_quaternion((0, 0, math.sin(math.pi / 6), math.cos(math.pi / 6)))
    assert np.allclose(a.r, b.r)
    assert np.allclose((a @ a.inverse()).matrix, np.eye(4))


def test_plane_from_line_is_none():
    p = [np.array([float(i), 0.0, 0.0]) for i in range(3)]
    assert g.plane_from_points(*p) is None
    assert np.allclose(g.plane_from_points(*np.eye(3)), [3**-0.5] * 3 + [-(3**-0.5)])


def test_voxel_key_round_trip(spark):
    df = spark.createDataFrame([(-5, 0, 7), (1 << 19, -(1 << 19), -1)], "a long, b long, c long")
    key = g.voxel_key(F.col("a"), F.col("b"), F.col("c"))
    back = df.withColumn("k", key).select("a", "b", "c", *[v.alias(n) for n, v in zip("xyz", g.voxel_of_key(F.col("k")), strict=True)])
    assert all(r["a"] == r["x"] and r["b"] == r["y"] and r["c"] == r["z"] for r in back.collect())


@pytest.mark.parametrize("angle", [0.0, 4.0, -4.0, 10.0])
def test_normalized_angle(spark, angle):
    v = spark.range(1).select(g.normalized_angle(F.lit(angle))).first()[0]
    assert abs(v) <= math.pi + 1e-12 and math.isclose(math.cos(v), math.cos(angle), abs_tol=1e-9)
