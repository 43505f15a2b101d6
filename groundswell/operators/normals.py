"""Normals and regularised covariances from neighbourhoods, by nearest neighbours or radius; a point counts as its own neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spatial import nearest, within
from .stencil import with_axes
from .voxel import moments

EPSILON = 1e-3
FLAT = 1.1920929e-07  # the least trace of a neighbourhood with extent: single-precision epsilon


def neighbourhoods(points: DataFrame, k: int | None = None, radius: float | None = None, guess: float | None = None) -> DataFrame:
    pairs = nearest(points, points, k, guess) if k else within(points, points, radius)
    found = points.select(F.col("point_id").alias("dst_id"), F.col("x").alias("nx_"), F.col("y").alias("ny_"), F.col("z").alias("nz_"))
    return with_axes(pairs.join(found, "dst_id").groupBy("src_id").agg(*moments("nx_", "ny_", "nz_")))


def with_normals(points: DataFrame, k: int | None = 20, radius: float | None = None, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0), guess: float | None = None, covariances: bool = False) -> DataFrame:
    """points with nx, ny, nz toward the viewpoint (zero where three neighbours are not found or have no extent).

    covariances: also the six columns of I - (1 - epsilon) n n^T, the plane-like covariance of registration; I where there is no normal.
    """
    fit = neighbourhoods(points, k, radius, guess)
    fit = fit.select("src_id", *[F.when((F.col("n") >= 3) & (F.col("cxx") + F.col("cyy") + F.col("czz") >= FLAT), F.col(a)).alias(a) for a in ("ax", "ay", "az")])
    met = points.join(fit, points["point_id"] == fit["src_id"], "left").drop("src_id")
    toward = sum(((F.lit(v) - F.col(c)) * F.col(f"a{c}") for v, c in zip(viewpoint, "xyz", strict=True)), F.lit(0.0))
    sign = F.when(toward < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    out = met.withColumns({f"n{c}": F.coalesce(F.col(f"a{c}") * sign, F.lit(0.0)) for c in "xyz"})
    if covariances:
        out = out.withColumns({f"c{a}{b}": F.lit(1.0 if a == b else 0.0) - (1 - EPSILON) * F.col(f"n{a}") * F.col(f"n{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")})
    return out.drop("ax", "ay", "az")


def mended_covariances(points: DataFrame) -> DataFrame:
    """Points whose covariances are regularised ahead of registration: any that is not finite becomes epsilon times I."""
    names = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    sound = F.lit(True)
    for n in names:
        sound = sound & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    return points.withColumns({n: F.when(sound, F.col(n)).otherwise(F.lit(EPSILON if n[1] == n[2] else 0.0)) for n in names})
