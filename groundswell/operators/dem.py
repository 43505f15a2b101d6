"""A terrain model from one cloud: outliers out, floating points out, cells, holes filled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import Grid
from .raster import CELL, fitted_grid, from_points
from .spatial import statistical_outliers_removed
from .stencil import inpainted


def floating_points_removed(points: DataFrame, grid: Grid, height: float = 2.0, bin_size: float | None = None) -> DataFrame:
    """Points of a cell up to so far above its ground: the fullest bin of its heights, the lowest of equals."""
    size = bin_size or grid.resolution
    celled = grid.celled(points)
    lows = celled.groupBy(*CELL).agg(F.min("z").alias("low"))
    bins = celled.join(lows, list(CELL)).withColumn("bin", F.floor((F.col("z") - F.col("low")) / size).cast("long"))
    full = bins.groupBy(*CELL, "low", "bin").agg(F.count(F.lit(1)).alias("n"))
    ground = full.groupBy(*CELL).agg(F.max_by(F.col("low") + (F.col("bin") + 0.5) * size, F.struct("n", -F.col("bin"))).alias("ground"))
    return celled.join(ground, list(CELL)).where(F.col("z") <= F.col("ground") + height).select(points.columns)


@dataclass(frozen=True)
class DemConfig:
    resolution: float = 0.1
    method: str = "max"
    neighbours: int = 10
    deviations: float = 1.0
    height: float = 2.0
    bin_size: float = 0.0
    passes: int = 3
    search: float | None = None  # first radius of the neighbour search; by density where none is given


def build_dem(points: DataFrame, config: DemConfig = DemConfig()) -> tuple[DataFrame, Grid]:
    kept = statistical_outliers_removed(points, config.neighbours, config.deviations, config.search) if config.neighbours else points
    grid = fitted_grid(kept, config.resolution)
    low = floating_points_removed(kept, grid, config.height, config.bin_size or None)
    cells = from_points(low, grid, config.method)
    if not config.passes:
        return cells, grid
    filled = inpainted(cells, grid, config.passes, 2)
    return filled.join(cells.drop("elevation"), list(CELL), "left"), grid


__all__ = ["DemConfig", "build_dem", "floating_points_removed"]
