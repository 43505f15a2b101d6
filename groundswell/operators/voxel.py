"""Downsampling and statistics by voxel and grid cell: one grouped aggregation each, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import cell, voxel, voxel_centre
from .filters import remove_invalid

VOXEL = ("vx", "vy", "vz")


def checked(size: float) -> float:
    if not 0.001 <= size <= 100:
        raise ValueError(f"the cell size must be from 0.001 to 100, not {size}")
    return size


def voxelled(points: DataFrame, size: float) -> DataFrame:
    """Points with finite coordinates and their voxel's indexes."""
    return remove_invalid(points).withColumns({v: voxel(F.col(c), checked(size)) for v, c in zip(VOXEL, "xyz", strict=True)})


def averaged(columns: list[str]) -> list[Column]:
    """Channels of a voxel's average: means, the first point's ring, label and covariances, colours cut to whole numbers."""
    out = [F.avg(c).alias(c) for c in ("x", "y", "z", "intensity", "t") if c in columns]
    if "color" in columns:
        part = lambda shift: F.floor(F.avg(F.shiftright("color", shift).bitwiseAND(F.lit(255)))).cast("int")
        out.append((F.shiftleft(part(16), 16) + F.shiftleft(part(8), 8) + part(0)).alias("color"))
    out += [F.min_by(c, "point_id").alias(c) for c in ("scan_id", "frame_id", "ring", "label", "cxx", "cxy", "cxz", "cyy", "cyz", "czz") if c in columns]
    if {"nx", "ny", "nz"} <= set(columns):
        total = [F.sum(c) for c in ("nx", "ny", "nz")]
        norm = F.sqrt(total[0] * total[0] + total[1] * total[1] + total[2] * total[2])
        out += [F.when(norm > 1e-6, F.try_divide(s, norm)).otherwise(F.lit(up)).alias(c) for c, s, up in zip(("nx", "ny", "nz"), total, (0.0, 0.0, 1.0), strict=True)]
    return out


def voxel_grid(points: DataFrame, size: float, keep: str = "centroid") -> DataFrame:
    """One point a voxel. keep: centroid, nearest (to the voxel's centre), any (that of the smallest id) or center."""
    v = voxelled(points, size)
    if keep in ("centroid", "center"):
        out = v.groupBy(*VOXEL).agg(F.min("point_id").alias("point_id"), F.count(F.lit(1)).alias("n"), *averaged(points.columns))
        if keep == "center":
            out = out.withColumns({c: voxel_centre(F.col(k), size) for k, c in zip(VOXEL, "xyz", strict=True)})
        return out
    row = F.struct(*points.columns)
    if keep == "nearest":
        d2 = sum(((F.col(c) - voxel_centre(F.col(k), size)) * (F.col(c) - voxel_centre(F.col(k), size)) for k, c in zip(VOXEL, "xyz", strict=True)), F.lit(0.0))
        chosen = F.min_by(row, F.struct(d2.alias("d2"), "point_id"))
    elif keep == "any":
        chosen = F.min_by(row, "point_id")
    else:
        raise ValueError(f"keep is centroid, nearest, any or center, not {keep}")
    return v.groupBy(*VOXEL).agg(chosen.alias("p")).select(*VOXEL, "p.*")


def grid_max_z(points: DataFrame, size: float) -> DataFrame:
    """The highest point of each XY cell, the smallest id on ties."""
    cells = remove_invalid(points).withColumns({"cx": cell(F.col("x"), checked(size)), "cy": cell(F.col("y"), size)})
    return cells.groupBy("cx", "cy").agg(F.max_by(F.struct(*points.columns), F.struct("z", (-F.col("point_id")).alias("i"))).alias("p")).select("cx", "cy", "p.*")


def moments(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """n, means and population covariances, from sums that combine across tasks."""
    names = {"x": x, "y": y, "z": z}
    out = [F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"m{k}") for k, v in names.items())]
    return out + [F.covar_pop(names[a], names[b]).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]


def voxel_distributions(points: DataFrame, size: float, epsilon: float = 1e-3) -> DataFrame:
    """Mean and covariance by voxel; below three points the covariance is epsilon times the identity."""
    out = voxelled(points, size).groupBy(*VOXEL).agg(*moments())
    few = F.col("n") < 3
    return out.withColumns({f"c{a}{b}": F.when(few, F.lit(epsilon if a == b else 0.0)).otherwise(F.col(f"c{a}{b}")) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")})
