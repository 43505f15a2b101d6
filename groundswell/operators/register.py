"""Registration of two clouds: point-to-point, point-to-plane, generalised and voxelised generalised ICP.

The driver holds one 6-by-6 system. Each round moves the source by literals, finds correspondences by a join, and
brings back one aggregate row: 21 numbers of H, 6 of b, the error and the count, summed partially in each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import COVARIANCE, Rigid, robust_weight, rotated_covariance, se3_exp, transformed
from ..plans.tables import stored
from .spatial import closest
from .voxel import VOXEL, voxel_distributions, voxelled


@dataclass(frozen=True)
class Settings:
    most_iterations: int = 50
    max_distance: float = 1.0
    rotation_eps: float = 1e-4
    translation_eps: float = 1e-4
    error_eps: float = 1e-6
    min_correspondences: int = 10
    damping: float = 1e-3
    kernel: str = "none"
    kernel_scale: float | None = None
    voxel: float = 1.0


@dataclass
class Result:
    transform: np.ndarray
    fitness: float = 0.0
    rmse: float = math.inf
    iterations: int = 0
    converged: bool = False
    covariance: np.ndarray | None = field(default=None)


P, Q, N = ("x", "y", "z"), ("qx", "qy", "qz"), ("qnx", "qny", "qnz")


def correspondences(source: DataFrame, target: DataFrame, max_distance: float) -> DataFrame:
    """Each source point (x, y, z, columns) with its nearest target point within the distance (strictly): qx, qy, qz and its channels, q-named."""
    near = closest(source, target, max_distance)
    renamed = target.select(F.col("point_id").alias("dst_id"), *[F.col(c).alias(f"q{c}") for c in target.columns if c in (*P, "nx", "ny", "nz", *COVARIANCE)])
    return source.join(near, source["point_id"] == near["src_id"]).join(renamed, "dst_id")


def voxel_correspondences(source: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """Each source point with the mean and covariance of the target voxel that it lies in."""
    means = voxels.select(*VOXEL, *[F.col(f"m{c}").alias(f"q{c}") for c in P], *[F.col(c).alias(f"q{c}") for c in COVARIANCE])
    return voxelled(source, size).join(means, list(VOXEL))


def cross_jacobian() -> list[list[Column]]:
    """Rows of d(residual)/d(v, w) for residual = T p - q, at T p = (x, y, z): I and -skew(T p)."""
    one, zero = F.lit(1.0), F.lit(0.0)
    x, y, z = (F.col(c) for c in P)
    return [[one, zero, zero, zero, z, -y], [zero, one, zero, -z, zero, x], [zero, zero, one, y, -x, zero]]


def total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def system(rows: list[list[Column]], residuals: list[Column], weight: list[list[Column]] | None, scale: Column) -> list[Column]:
    """Sums of J^T W J (upper triangle), J^T W r, r^T W r, and the count."""
    k = range(len(rows))
    w = weight or [[F.lit(1.0) if a == b else None for b in k] for a in k]

    def form(left: list[Column], right: list[Column]) -> Column:
        return total([left[a] * w[a][b] * right[b] for a in k for b in k if w[a][b] is not None])

    column = lambda i: [r[i] for r in rows]
    out = [F.sum(scale * form(column(i), column(j))).alias(f"h{i}{j}") for i in range(6) for j in range(i, 6)]
    out += [F.sum(scale * form(column(i), residuals)).alias(f"b{i}") for i in range(6)]
    return [*out, F.sum(scale * form(residuals, residuals)).alias("error"), F.count(F.lit(1)).alias("n")]


def inverse3(m: list[Column]) -> list[list[Column]]:
    """Of a symmetric 3-by-3: xx, xy, xz, yy, yz, zz."""
    a, b, c, d, e, f = m
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    i = [F.try_divide(v, det) for v in (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)]
    return [[i[0], i[1], i[2]], [i[1], i[3], i[4]], [i[2], i[4], i[5]]]


def linearized(pairs: DataFrame, method: str, settings: Settings) -> list[Column]:
    r = [F.col(p) - F.col(q) for p, q in zip(P, Q, strict=True)]
    jac = cross_jacobian()
    if method == "point":  # the robust kernel has no part in this one
        return system(jac, r, None, F.lit(1.0))
    if method == "plane":
        n = [F.col(c) for c in N]
        apart = total([a * b for a, b in zip(n, r, strict=True)])
        row = [total([n[k] * jac[k][i] for k in range(3)]) for i in range(6)]
        return system([row], [apart], None, robust_weight(apart, settings.kernel, settings.kernel_scale))
    c = [F.col(k) + F.col(f"q{k}") for k in COVARIANCE]
    w = inverse3(c)
    size = F.sqrt(total([r[a] * w[a][b] * r[b] for a in range(3) for b in range(3)]))
    return system(jac, r, w, robust_weight(size, settings.kernel, settings.kernel_scale))


# --- solvers: how far to step, given the system at a transform ----------------------------------------------------------

#: Error of the pairs that another transform finds; each call is a job.
ErrorAt = Callable[[np.ndarray], float]


@dataclass
class Damped:
    """A fixed damping; none with 0 but for what keeps the system solvable."""

    damping: float = 1e-3

    def step(self, h: np.ndarray, b: np.ndarray, transform: np.ndarray, error: float, error_at: ErrorAt) -> np.ndarray:
        return np.linalg.solve(h + max(self.damping, 1e-12) * np.eye(6), -b)


@dataclass
class Adaptive:
    """Damping that falls after a step that lowers the error, and grows until one does; no step if none does."""

    damping: float = 1e-3
    factor: float = 10.0
    tries: int = 10

    def step(self, h: np.ndarray, b: np.ndarray, transform: np.ndarray, error: float, error_at: ErrorAt) -> np.ndarray:
        for _ in range(self.tries):
            delta = np.linalg.solve(h + self.damping * np.eye(6), -b)
            if error_at(se3_exp(delta) @ transform) < error:
                self.damping /= self.factor
                return delta
            self.damping *= self.factor
        return np.zeros(6)


@dataclass(frozen=True)
class Factor:
    """What a registration minimises: pairs of the moved source with the target, and the sums of their linear system. needs: channels
    that source and target must have."""

    pairs: Callable[[DataFrame, DataFrame, Settings], DataFrame]
    sums: Callable[[DataFrame, Settings], list[Column]]
    needs: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())


def _by_distance(here: DataFrame, target: DataFrame, settings: Settings) -> DataFrame:
    return correspondences(here, target, settings.max_distance)


def _by_voxel(here: DataFrame, voxels: DataFrame, settings: Settings) -> DataFrame:
    return voxel_correspondences(here, voxels, settings.voxel)


FACTORS = {
    "point": Factor(_by_distance, lambda pairs, s: linearized(pairs, "point", s)),
    "plane": Factor(_by_distance, lambda pairs, s: linearized(pairs, "plane", s), ((), ("nx",))),
    "gicp": Factor(_by_distance, lambda pairs, s: linearized(pairs, "gicp", s), (("cxx",), ("cxx",))),
    "vgicp": Factor(_by_voxel, lambda pairs, s: linearized(pairs, "vgicp", s), (("cxx",), ())),
}


def align(source: DataFrame, target: DataFrame, method: str | Factor = "point", guess: np.ndarray | None = None, settings: Settings = Settings(), voxels: DataFrame | None = None, solver: Damped | Adaptive | None = None) -> Result:
    """method: point, plane (target has normals), gicp (both have covariances), vgicp (source has; voxels or target), or a factor of
    one's own. solver: fixed damping by the settings, if none is given."""
    factor = FACTORS[method] if isinstance(method, str) else method
    for cloud, channels in zip((source, target), factor.needs, strict=True):
        for channel in channels:
            if channel not in cloud.columns:
                raise ValueError(f"{method} needs the channel {channel}")
    source = stored(source, "source")
    target = stored(target, "target")
    if method == "vgicp":
        target = stored(voxels if voxels is not None else regularized_voxels(target, settings.voxel), "voxels")
    solver = solver or Damped(settings.damping)

    def system_at(transform: np.ndarray):  # noqa: ANN202
        pose = Rigid.of(transform)
        pairs = factor.pairs(transformed(rotated_covariance(source, pose) if "cxx" in source.columns else source, pose), target, settings)
        return pairs.agg(*factor.sums(pairs, settings)).first()

    whole = source.count()
    result = Result(np.eye(4) if guess is None else np.array(guess, dtype=float))
    before = math.inf
    for k in range(settings.most_iterations):
        s = system_at(result.transform)
        if s["n"] < settings.min_correspondences:
            return result
        h = np.zeros((6, 6))
        for i in range(6):
            for j in range(i, 6):
                h[i, j] = h[j, i] = s[f"h{i}{j}"]
        delta = solver.step(h, np.array([s[f"b{i}"] for i in range(6)]), result.transform, s["error"], lambda t: system_at(t)["error"] or math.inf)
        result.transform = se3_exp(delta) @ result.transform
        result.iterations, result.fitness, result.rmse = k + 1, s["n"] / max(1, whole), math.sqrt(s["error"] / s["n"])
        result.covariance = np.linalg.inv(h + 1e-12 * np.eye(6))
        small = np.linalg.norm(delta[:3]) < settings.translation_eps and np.linalg.norm(delta[3:]) < settings.rotation_eps
        steady = before < math.inf and abs(before - s["error"]) < settings.error_eps * max(before, 1e-300)
        before = s["error"]
        if small or steady:
            result.converged = True
            break
    return result


def regularized_voxels(points: DataFrame, size: float, epsilon: float = 1e-3) -> DataFrame:
    """Voxel means with plane-like covariances: I - (1 - epsilon) n n^T; I below three points."""
    from .stencil import with_axes

    fit = with_axes(voxel_distributions(points, size, epsilon))
    entry = lambda a, b: F.lit(1.0 if a == b else 0.0) - F.when(F.col("n") >= 3, (1 - epsilon) * F.col(f"a{a}") * F.col(f"a{b}")).otherwise(F.lit(0.0))
    return fit.withColumns({f"c{a}{b}": entry(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}).drop("l0", "l1", "l2", "ax", "ay", "az")


def result_row(spark, r: Result) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([([float(v) for v in r.transform[:3].ravel()], float(r.fitness), float(r.rmse), r.iterations, r.converged)], "transform array<double>, fitness double, rmse double, iterations int, converged boolean")


__all__ = ["FACTORS", "Adaptive", "Damped", "Factor", "Result", "Settings", "align", "correspondences", "linearized", "regularized_voxels", "result_row", "voxel_correspondences"]
