"""Points to map cells and back. Cells are rows (row, col); a layer is a column; not measured is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import Grid

CELL = ("row", "col")


def rasterized(points: DataFrame, grid: Grid, by: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Facts of each scan and cell: lowest point with its height variance (the smallest id on ties), highest, brightest, last colour, count."""
    inside = grid.celled(points)
    facts = [F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count(F.lit(1)).alias("n")]
    if "czz" in points.columns:
        facts.append(F.min_by("czz", F.struct("z", "point_id")).alias("min_z_var"))
    if "intensity" in points.columns:
        facts.append(F.max("intensity").alias("max_intensity"))
    if "color" in points.columns:
        facts.append(F.max_by("color", "point_id").alias("color"))
    return inside.groupBy(*by, *CELL).agg(*facts)


def from_points(points: DataFrame, grid: Grid, method: str = "max") -> DataFrame:
    """A map in one go: elevation by method (max, min, mean, minmax), with spread, bounds, count, brightest and last colour."""
    elevation = {"max": F.max("z"), "minmax": F.max("z"), "min": F.min("z"), "mean": F.avg("z")}[method.lower()]
    layers = [elevation.alias("elevation"), F.min("z").alias("elevation_min"), F.max("z").alias("elevation_max"), F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("variance"), F.count(F.lit(1)).alias("n_points")]
    if "intensity" in points.columns:
        layers.append(F.max("intensity").alias("intensity"))
    if "color" in points.columns:
        layers.append(F.max_by("color", "point_id").alias("color"))
    return grid.celled(points.where(F.col("z").isNotNull() & ~F.isnan("z"))).groupBy(*CELL).agg(*layers)


def fitted_grid(points: DataFrame, resolution: float) -> Grid:
    """A map around all points, one cell wider on each side. One aggregate row reaches the driver: geometry is literal."""
    b = points.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if b["lox"] is None:
        return Grid(resolution, resolution, resolution)
    return Grid(b["hix"] - b["lox"] + 2 * resolution, b["hiy"] - b["loy"] + 2 * resolution, resolution, (b["hix"] + b["lox"]) / 2, (b["hiy"] + b["loy"]) / 2)


def to_points(cells: DataFrame, grid: Grid, layer: str = "elevation") -> DataFrame:
    """A point at the centre of each measured cell."""
    kept = [c for c in ("intensity", "color") if c in cells.columns]
    return cells.where(F.col(layer).isNotNull()).select((F.col("row") * grid.cols + F.col("col")).alias("point_id"), grid.x_of(F.col("row")).alias("x"), grid.y_of(F.col("col")).alias("y"), F.col(layer).alias("z"), *kept)


def running_bounds(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*CELL).agg(F.min("min_z").alias("elevation_min"), F.max("max_z").alias("elevation_max"))


def obstacle(facts: DataFrame, order: str = "scan_id") -> DataFrame:
    """Of the last scan with any cell: the highest point where a cell has several heights, else null."""
    last = facts.agg(F.max(order).alias("__last"))
    height = F.when(F.col("max_z") > F.col("min_z"), F.col("max_z"))
    return facts.join(F.broadcast(last), F.col(order) == F.col("__last")).select(*CELL, height.alias("obstacle"))  # one row


def latest_layers(facts: DataFrame, order: str = "scan_id") -> DataFrame:
    """The brightest intensity of all scans, and the colour of the last scan that saw the cell."""
    out: list[Column] = [F.max("max_intensity").alias("intensity")] if "max_intensity" in facts.columns else []
    if "color" in facts.columns:
        out.append(F.max_by("color", order).alias("color"))
    return facts.groupBy(*CELL).agg(*out)


def elevation_at(cells: DataFrame, grid: Grid, x: float, y: float, layer: str = "elevation") -> DataFrame:
    """The layer at a position: no row where nothing is measured or the map does not reach."""
    at = cells.sparkSession.range(1).select(grid.row(F.lit(float(x))).alias("r"), grid.col(F.lit(float(y))).alias("c"))
    return cells.join(F.broadcast(at), (F.col("row") == F.col("r")) & (F.col("col") == F.col("c"))).where(F.col(layer).isNotNull()).select(*CELL, layer)


def snapshot(cells: DataFrame, layers: list[str]) -> DataFrame:
    return cells.select(*CELL, *layers)


def map_stats(cells: DataFrame, grid: Grid, layer: str = "elevation") -> DataFrame:
    v = F.col(layer)
    return cells.agg((F.count(v) * 100.0 / (grid.rows * grid.cols)).alias("coverage"), F.min(v).alias("min_z"), F.avg(v).alias("mean_z"), F.max(v).alias("max_z"))
