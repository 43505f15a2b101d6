"""Ray casting over the map grid: which cells a beam crosses and how low, and what that says about ghosts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import Grid
from .raster import CELL


def walked(start: np.ndarray, end: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ray, row, col, height) of every cell that the segments cross inside the map; all rays step together.

    A cell's height is the segment's where it leaves the cell. The time of each axis' next crossing grows by repeated
    addition, as rounding decides corner ties; on a tie the column steps first.
    """
    g0 = np.stack([(grid.top_x - start[:, 0]) / grid.resolution, (grid.top_y - start[:, 1]) / grid.resolution], 1)
    g1 = np.stack([(grid.top_x - end[:, 0]) / grid.resolution, (grid.top_y - end[:, 1]) / grid.resolution], 1)
    delta = g1 - g0
    at = np.floor(g0).astype(np.int64)
    step = np.sign(delta).astype(np.int64)
    still = np.abs(delta) <= 1e-8
    with np.errstate(divide="ignore", invalid="ignore"):
        following = np.where(still, 1e30, (np.where(step > 0, at + 1, at) - g0) / delta)
        each = np.where(still, 0.0, 1 / np.abs(delta))
    live = np.flatnonzero(np.linalg.norm(end - start, axis=1) >= 1e-4)
    rise = end[:, 2] - start[:, 2]
    out: list[tuple[np.ndarray, ...]] = []
    for _ in range(grid.rows + grid.cols):
        if not len(live):
            break
        leave = following[live].min(1)
        inside = np.full(len(live), True) if grid.unbounded else (at[live] >= 0).all(1) & (at[live, 0] < grid.rows) & (at[live, 1] < grid.cols)
        kept = live[inside]
        out.append((kept, at[kept, 0], at[kept, 1], start[kept, 2] + np.minimum(leave[inside], 1.0) * rise[kept]))
        live = live[leave < 1]
        axis = np.where(following[live, 0] < following[live, 1], 0, 1)
        at[live, axis] += step[live, axis]
        following[live, axis] += each[live, axis]
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, float))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ray_heights(points: DataFrame, grid: Grid) -> DataFrame:
    """scan_id, row, col, ray: the lowest beam over each cell. points carry their sensor's place as ox, oy, oz.

    Only points below their sensor are traced, and only sensors inside the map. Each batch of points is reduced to one
    row for each cell before the shuffle.
    """
    seen = points.where(F.col("z") < F.col("oz")).withColumns({"__r": grid.row(F.col("ox")), "__c": grid.col(F.col("oy"))}).where(grid.holds(F.col("__r"), F.col("__c")))
    rows = seen.select(F.col("scan_id").cast("long"), *[F.col(c).cast("double") for c in ("ox", "oy", "oz", "x", "y", "z")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                v = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                ray, row, col, height = walked(np.stack(v[1:4], 1), np.stack(v[4:7], 1), grid)
                scan = v[0][ray]
                order = np.lexsort((height, col, row, scan))
                scan, row, col, height = scan[order], row[order], col[order], height[order]
                first = np.ones(len(scan), dtype=bool)
                first[1:] = (scan[1:] != scan[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(c[first]) for c in (scan, row, col, height)], names=["scan_id", "row", "col", "ray"])

    return rows.mapInArrow(run, "scan_id long, row long, col long, ray double").groupBy("scan_id", *CELL).agg(F.min("ray").alias("ray"))


def observed(points: DataFrame, grid: Grid) -> DataFrame:
    """scan_id, row, col, hits: the points in each cell."""
    return grid.celled(points).groupBy(F.col("scan_id").cast("long").alias("scan_id"), *CELL).agg(F.count(F.lit(1)).alias("hits"))


def evidence(facts: DataFrame, thinned: DataFrame, grid: Grid, extras: list[Column] | None = None) -> DataFrame:
    """All that a scan says of a cell, for estimate.fold: z, variance and extras of facts, hits and lowest ray of the thinned points."""
    a = facts.select(F.col("scan_id").cast("long").alias("scan_id"), *CELL, F.col("min_z").alias("z"), (F.col("min_z_var") if "min_z_var" in facts.columns else F.lit(0.0)).alias("variance"), *(extras or []))
    keys = ["scan_id", *CELL]
    return a.join(observed(thinned, grid), keys, "full_outer").join(ray_heights(thinned, grid), keys, "full_outer")
