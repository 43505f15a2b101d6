"""Column expressions of rigid geometry, angles, grids and robust weights. Everything stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

XYZ = ("x", "y", "z")
COVARIANCE = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


@dataclass(frozen=True)
class Rigid:
    """A rigid motion: rotation, row by row, then translation."""

    r: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    t: tuple[float, ...] = (0.0, 0.0, 0.0)

    @staticmethod
    def of(matrix: np.ndarray) -> Rigid:
        return Rigid(tuple(float(v) for v in matrix[:3, :3].ravel()), tuple(float(v) for v in matrix[:3, 3]))

    @property
    def matrix(self) -> np.ndarray:
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = np.reshape(self.r, (3, 3)), self.t
        return out

    def inverse(self) -> Rigid:
        return Rigid.of(np.linalg.inv(self.matrix))

    def __matmul__(self, other: Rigid) -> Rigid:
        return Rigid.of(self.matrix @ other.matrix)

    @staticmethod
    def from_rpy(roll: float, pitch: float, yaw: float, t: Sequence[float] = (0, 0, 0)) -> Rigid:
        a, b, c = (np.array(m) for m in (
            [[1, 0, 0], [0, math.cos(roll), -math.sin(roll)], [0, math.sin(roll), math.cos(roll)]],
            [[math.cos(pitch), 0, math.sin(pitch)], [0, 1, 0], [-math.sin(pitch), 0, math.cos(pitch)]],
            [[math.cos(yaw), -math.sin(yaw), 0], [math.sin(yaw), math.cos(yaw), 0], [0, 0, 1]],
        ))
        return Rigid(tuple((c @ b @ a).ravel().tolist()), tuple(map(float, t)))

    @staticmethod
    def from_2d(x: float, y: float, yaw: float) -> Rigid:
        return Rigid.from_rpy(0, 0, yaw, (x, y, 0))

    @staticmethod
    def from_quaternion(q: Sequence[float], t: Sequence[float] = (0, 0, 0)) -> Rigid:
        """q: x, y, z, w, of any length but zero."""
        x, y, z, w = np.asarray(q, dtype=float) / np.linalg.norm(q)
        rows = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
        return Rigid(tuple(map(float, rows)), tuple(map(float, t)))


def rotated(r: Sequence[float], v: Sequence[Column]) -> list[Column]:
    return [F.lit(r[3 * i]) * v[0] + F.lit(r[3 * i + 1]) * v[1] + F.lit(r[3 * i + 2]) * v[2] for i in range(3)]


def transformed(points: DataFrame, pose: Rigid, frame: str | None = None) -> DataFrame:
    """Points moved, normals turned, covariances left as they are; frame_id set if a frame is given."""
    out = {c: v + F.lit(t) for c, v, t in zip(XYZ, rotated(pose.r, [F.col(c) for c in XYZ]), pose.t, strict=True)}
    if {"nx", "ny", "nz"} <= set(points.columns):
        out |= dict(zip(("nx", "ny", "nz"), rotated(pose.r, [F.col(c) for c in ("nx", "ny", "nz")]), strict=True))
    if frame is not None:
        out["frame_id"] = F.lit(frame)
    return points.withColumns(out)


def rotated_covariance(points: DataFrame, pose: Rigid) -> DataFrame:
    """R C R^T of the six covariance columns; whichever are not read later are pruned."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in COVARIANCE)
    full = ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))
    r = np.reshape(pose.r, (3, 3))

    def entry(i: int, j: int) -> Column:
        return sum((F.lit(float(r[i, a] * r[j, b])) * full[a][b] for a in range(3) for b in range(3)), F.lit(0.0))

    return points.withColumns({name: entry(i, j) for name, (i, j) in zip(COVARIANCE, ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), strict=True)})


def normalized_angle(a: Column) -> Column:
    """To [-pi, pi]."""
    return a - F.lit(2 * math.pi) * F.floor((a + F.lit(math.pi)) / F.lit(2 * math.pi))


def rpy(r: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw (Z-Y-X) of a rotation, row by row; where the pitch is upright the roll is 0."""
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[6])))
    tilted = F.cos(pitch) > 1e-6
    return F.when(tilted, F.atan2(r[7], r[8])).otherwise(F.lit(0.0)), pitch, F.when(tilted, F.atan2(r[3], r[0])).otherwise(F.atan2(-r[1], r[4]))


def slerp_weights(dot: Column, t: Column) -> tuple[Column, Column]:
    """What two unit quaternions with this dot product weigh at t along the shorter arc; linear where they almost agree."""
    cos = F.least(F.abs(dot), F.lit(1.0))
    angle, flat = F.acos(cos), cos > 1 - 1e-10
    wa = F.when(flat, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
    wb = F.when(flat, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle)))
    return wa, wb * F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def slerped(qa: Sequence[Column], qb: Sequence[Column], t: Column) -> list[Column]:
    """Unit quaternions (x, y, z, w) interpolated along the shorter arc."""
    wa, wb = slerp_weights(sum((a * b for a, b in zip(qa, qb, strict=True)), F.lit(0.0)), t)
    return [wa * a + wb * b for a, b in zip(qa, qb, strict=True)]


def with_slerped(rows: DataFrame, qa: Sequence[Column], qb: Sequence[Column], t: Column, names: Sequence[str]) -> DataFrame:
    """rows with slerped as columns. Dot product and weights are columns of their own on the way: written out four times in one
    expression they would outgrow what the JVM compiles."""
    held = ("__t", "__dot", "__wa", "__wb")
    rows = rows.withColumns({"__t": t, "__dot": sum((a * b for a, b in zip(qa, qb, strict=True)), F.lit(0.0))})
    rows = rows.withColumns(dict(zip(held[2:], slerp_weights(F.col("__dot"), F.col("__t")), strict=True)))
    return rows.withColumns({n: F.col("__wa") * a + F.col("__wb") * b for n, a, b in zip(names, qa, qb, strict=True)}).drop(*held)


def rotation_of(q: Sequence[Column]) -> list[Column]:
    """The rotation, row by row, of a unit quaternion x, y, z, w."""
    x, y, z, w = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


# --- Lie groups, for six-vectors on the driver --------------------------------------------------------------------


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def so3_exp(w: np.ndarray) -> np.ndarray:
    a, k = float(np.linalg.norm(w)), skew(w)
    if a < 1e-10:
        return np.eye(3) + k
    return np.eye(3) + math.sin(a) / a * k + (1 - math.cos(a)) / a**2 * k @ k


def so3_log(r: np.ndarray) -> np.ndarray:
    cos = min(1.0, max(-1.0, (np.trace(r) - 1) / 2))
    a, v = math.acos(cos), np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if a < 1e-10:
        return v / 2
    if math.pi - a < 1e-6:  # the axis is the column of R + I that is longest
        m = r + np.eye(3)
        axis = m[:, int(np.argmax(np.linalg.norm(m, axis=0)))]
        return a * axis / np.linalg.norm(axis)
    return a / (2 * math.sin(a)) * v


def left_jacobian(w: np.ndarray) -> np.ndarray:
    a, k = float(np.linalg.norm(w)), skew(w)
    if a < 1e-10:
        return np.eye(3) + k / 2
    return np.eye(3) + (1 - math.cos(a)) / a**2 * k + (a - math.sin(a)) / a**3 * k @ k


def left_jacobian_inverse(w: np.ndarray) -> np.ndarray:
    a, k = float(np.linalg.norm(w)), skew(w)
    if a < 1e-10:
        return np.eye(3) - k / 2
    return np.eye(3) - k / 2 + (1 / a**2 - (1 + math.cos(a)) / (2 * a * math.sin(a))) * k @ k


def se3_exp(xi: np.ndarray) -> np.ndarray:
    """xi: translation part, then rotation part."""
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = so3_exp(xi[3:]), left_jacobian(xi[3:]) @ xi[:3]
    return out


def se3_log(m: np.ndarray) -> np.ndarray:
    w = so3_log(m[:3, :3])
    return np.concatenate([left_jacobian_inverse(w) @ m[:3, 3], w])


# --- grids --------------------------------------------------------------------------------------------------------

VOXEL_LIMIT = 1 << 20


def cell(value: Column, size: float) -> Column:
    """floor(value / size), by the reciprocal."""
    return F.floor(value * F.lit(1.0 / size)).cast("long")


def voxel(value: Column, size: float) -> Column:
    """A cell index, held to 21 bits."""
    return F.least(F.greatest(cell(value, size), F.lit(-VOXEL_LIMIT)), F.lit(VOXEL_LIMIT - 1)).cast("long")


def voxel_key(vx: Column, vy: Column, vz: Column) -> Column:
    """Three indexes in one number: z, y, x from the top, 21 bits each."""
    at = lambda v: (v + F.lit(VOXEL_LIMIT)).cast("long")
    return F.shiftleft(at(vz), 42).bitwiseOR(F.shiftleft(at(vy), 21)).bitwiseOR(at(vx))


def voxel_of_key(key: Column) -> tuple[Column, Column, Column]:
    low = lambda k: k.bitwiseAND(F.lit((1 << 21) - 1)) - F.lit(VOXEL_LIMIT)
    return low(key), low(F.shiftright(key, 21)), low(F.shiftright(key, 42))


def voxel_centre(index: Column, size: float) -> Column:
    return (index.cast("double") + 0.5) * F.lit(size)


@dataclass(frozen=True)
class Grid:
    """A map's rectangle: rows grow toward -x, columns toward -y; cells are half open toward the centre's far side."""

    length_x: float
    length_y: float
    resolution: float
    centre_x: float = 0.0
    centre_y: float = 0.0
    unbounded: bool = False  # the rectangle is only an origin: cells go on beyond it

    @property
    def rows(self) -> int:
        return round(self.length_x / self.resolution)

    @property
    def cols(self) -> int:
        return round(self.length_y / self.resolution)

    @property
    def top_x(self) -> float:
        return self.centre_x + self.rows * self.resolution / 2

    @property
    def top_y(self) -> float:
        return self.centre_y + self.cols * self.resolution / 2

    def row(self, x: Column) -> Column:
        return F.floor((F.lit(self.top_x) - x) / F.lit(self.resolution)).cast("long")

    def col(self, y: Column) -> Column:
        return F.floor((F.lit(self.top_y) - y) / F.lit(self.resolution)).cast("long")

    def holds(self, row: Column, col: Column) -> Column:
        return F.lit(True) if self.unbounded else row.between(0, self.rows - 1) & col.between(0, self.cols - 1)

    def x_of(self, row: Column) -> Column:
        return F.lit(self.top_x - self.resolution / 2) - row * F.lit(self.resolution)

    def y_of(self, col: Column) -> Column:
        return F.lit(self.top_y - self.resolution / 2) - col * F.lit(self.resolution)

    def celled(self, points: DataFrame) -> DataFrame:
        """points inside the map, with row and col."""
        return points.withColumns({"row": self.row(F.col("x")), "col": self.col(F.col("y"))}).where(self.holds(F.col("row"), F.col("col")))


# --- planes and weights -------------------------------------------------------------------------------------------


def plane_from_points(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[float, float, float, float] | None:
    """Unit normal and offset of the plane through three points; none if they lie in a line."""
    n = np.cross(q - p, r - p)
    size = np.linalg.norm(n)
    if size < 1e-10:
        return None
    n = n / size
    return (*map(float, n), float(-n @ p))


def plane_distance(nx: Column, ny: Column, nz: Column, d: Column) -> Column:
    """Signed."""
    return nx * F.col("x") + ny * F.col("y") + nz * F.col("z") + d


#: Scales that robust weights are usually given: huber, tukey, cauchy. (fixed values)
ROBUST_SCALES = {"none": 1.0, "huber": 1.345, "tukey": 4.685, "cauchy": 2.385}


def robust_weight(residual: Column, kernel: str = "none", k: float | None = None) -> Column:
    k = ROBUST_SCALES[kernel] if k is None else k
    a = F.abs(residual)
    if kernel == "huber":
        return F.when(a <= k, F.lit(1.0)).otherwise(F.lit(k) / a)
    if kernel == "tukey":
        u = 1 - (a / k) * (a / k)
        return F.when(a <= k, u * u).otherwise(F.lit(0.0))
    if kernel == "cauchy":
        return 1 / (1 + (a / k) * (a / k))
    return F.lit(1.0)
