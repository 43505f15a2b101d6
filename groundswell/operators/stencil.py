"""Grid-neighbourhood operators. Each measured cell sends its value to the cells around it and one grouped aggregation
gathers them: a single shuffle, no self-join. Work grows with measured cells times the stencil, never with the map."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import Grid
from .raster import CELL


def disc(radius: float, resolution: float) -> list[tuple[int, int]]:
    """Offsets up to the radius, the centre included."""
    k = math.floor(radius / resolution + 1e-9)
    return [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if (i * i + j * j) * resolution * resolution <= radius * radius + 1e-12]


def box(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-(k // 2), k // 2 + 1) for j in range(-(k // 2), k // 2 + 1)]


def sent(cells: DataFrame, offsets: list[tuple[int, int]], grid: Grid | None, *values: Column) -> DataFrame:
    """Each cell's values at every offset from it: row, col, di, dj (from the receiver to the sender), values."""
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in offsets])
    out = cells.select(*CELL, F.explode(steps).alias("o"), *values)
    names = [c for c in out.columns if c not in (*CELL, "o")]
    out = out.select((F.col("row") - F.col("o.di")).alias("row"), (F.col("col") - F.col("o.dj")).alias("col"), F.col("o.di").alias("di"), F.col("o.dj").alias("dj"), *names)
    return out.where(grid.holds(F.col("row"), F.col("col"))) if grid else out


def inpainted(cells: DataFrame, grid: Grid, passes: int = 3, min_valid: int = 2, layer: str = "elevation") -> DataFrame:
    """Holes with enough measured neighbours of eight get their mean, pass after pass; row, col, layer, inside the map only."""
    now = cells.where(F.col(layer).isNotNull()).select(*CELL, F.col(layer).alias("v"))
    for _ in range(passes):
        given = sent(now, box(3), grid, F.col("v"))
        own = (F.col("di") == 0) & (F.col("dj") == 0)
        gathered = given.groupBy(*CELL).agg(F.max(F.when(own, F.col("v"))).alias("own"), F.sum(F.when(~own, F.col("v"))).alias("s"), F.count(F.when(~own, F.lit(1))).alias("n"))
        now = gathered.select(*CELL, F.coalesce("own", F.when(F.col("n") >= min_valid, F.col("s") / F.col("n"))).alias("v")).where(F.col("v").isNotNull())
    return now.select(*CELL, F.col("v").alias(layer))


def smoothed(cells: DataFrame, k: int = 3, min_valid: int = 5, layer: str = "elevation") -> DataFrame:
    """The upper median of each measured cell's box; cells with too few measured neighbours keep their value."""
    given = sent(cells.where(F.col(layer).isNotNull()), box(k), None, F.col(layer).alias("v"))
    own = F.max(F.when((F.col("di") == 0) & (F.col("dj") == 0), F.col("v"))).alias("own")
    gathered = given.groupBy(*CELL).agg(own, F.sort_array(F.collect_list("v")).alias("vs")).where(F.col("own").isNotNull())
    return gathered.select(*CELL, F.when(F.size("vs") >= min_valid, F.get("vs", F.floor(F.size("vs") / 2).cast("int"))).otherwise(F.col("own")).alias(layer))


def weighted_quantile(pairs: Column, p: float) -> Column:
    """Of sorted (value, weight): the first value whose running weight reaches p of the whole; of one, that one."""
    total = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + e["w"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))
    walk = F.aggregate(pairs, start, lambda a, e: F.struct((a["sum"] + e["w"]).alias("sum"), F.coalesce(a["v"], F.when(a["sum"] + e["w"] >= F.lit(p) * total, e["v"])).alias("v")))
    return F.coalesce(walk["v"], F.get(pairs, F.size(pairs) - 1)["v"])


def fused_uncertainty(cells: DataFrame, resolution: float, radius: float = 0.15, sigma: float = 0.05, low: float = 0.01, high: float = 0.99, min_valid: int = 3) -> DataFrame:
    """lower_bound and upper_bound as weighted quantiles of the bounds around, near and sharp ones first."""
    spread = F.col("upper_bound") - F.col("lower_bound")
    given = sent(cells.where(spread.isNotNull()), disc(radius, resolution), None, F.col("lower_bound").alias("lo"), F.col("upper_bound").alias("hi"))
    d2 = (F.col("di") * F.col("di") + F.col("dj") * F.col("dj")) * F.lit(resolution * resolution)
    given = given.withColumn("w", F.exp(-d2 / F.lit(2 * sigma * sigma)) / (F.col("hi") - F.col("lo") + 1e-4))
    heavy = F.col("w") > 1e-6
    pair = lambda v: F.sort_array(F.collect_list(F.when(heavy, F.struct(F.col(v).alias("v"), "w"))))
    own = (F.col("di") == 0) & (F.col("dj") == 0)
    got = given.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), pair("lo").alias("los"), pair("hi").alias("his"), F.max(F.when(own, F.col("lo"))).alias("lo"), F.max(F.when(own, F.col("hi"))).alias("hi")).where(F.col("lo").isNotNull())
    enough = (F.col("n") >= min_valid) & (F.size("los") > 0)
    return got.select(*CELL, F.when(enough, weighted_quantile(F.col("los"), low)).otherwise(F.col("lo")).alias("lower_bound"), F.when(enough, weighted_quantile(F.col("his"), high)).otherwise(F.col("hi")).alias("upper_bound"))


def uncertainty_range(cells: DataFrame) -> DataFrame:
    return cells.select(*CELL, (F.col("upper_bound") - F.col("lower_bound")).alias("uncertainty_range"))


PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def with_axes(rows: DataFrame) -> DataFrame:
    """rows with covariance columns cxx..czz: adds l0 <= l1 <= l2 and the unit direction (ax, ay, az) of l0."""
    added = ["l0", "l1", "l2", "ax", "ay", "az"]
    schema = rows.withColumns({c: F.lit(None).cast("double") for c in added}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {p: np.nan_to_num(batch.column(batch.schema.get_field_index(f"c{p}")).to_numpy(zero_copy_only=False).astype(float)) for p in PAIRS}
            m = np.stack([np.stack([c[min(a + b, b + a)] for b in "xyz"], 1) for a in "xyz"], 1)
            values, axes = np.linalg.eigh(m)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[:, i]) for i in range(3)), *(pa.array(axes[:, i, 0]) for i in range(3))], names=schema.names)

    return rows.mapInArrow(run, schema)


def neighbourhood_moments(cells: DataFrame, resolution: float, radius: float = 0.3, min_valid: int = 4, low: float = 0.05, high: float = 0.95, layer: str = "elevation") -> DataFrame:
    """For each measured cell: n, step (between two order statistics) and the population covariance of displacements around it."""
    given = sent(cells.where(F.col(layer).isNotNull()), disc(radius, resolution), None, F.col(layer).alias("z"))
    own = F.max(F.when((F.col("di") == 0) & (F.col("dj") == 0), F.col("z"))).alias("own")
    dx, dy = -F.col("di") * F.lit(resolution), -F.col("dj") * F.lit(resolution)
    v = {"x": dx, "y": dy, "z": F.col("z")}
    got = given.groupBy(*CELL).agg(own, F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("z")).alias("zs"), *[F.covar_pop(v[p[0]], v[p[1]]).alias(f"c{p}") for p in PAIRS])
    at = lambda p: F.get("zs", F.floor(F.lit(p) * (F.col("n") - 1)).cast("int"))
    return got.where(F.col("own").isNotNull() & (F.col("n") >= min_valid)).withColumn("step", at(high) - at(low)).drop("zs")


def terrain_features(cells: DataFrame, resolution: float, radius: float = 0.3, min_valid: int = 4, low: float = 0.05, high: float = 0.95, layer: str = "elevation") -> DataFrame:
    """step, slope (degrees), roughness, curvature and the upward normal, where the neighbours span a plane."""
    fit = with_axes(neighbourhood_moments(cells, resolution, radius, min_valid, low, high, layer)).where(F.col("l1") >= 1e-8)
    trace = F.col("l0") + F.col("l1") + F.col("l2")
    up = F.when(F.col("az") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return fit.select(
        *CELL, "step", F.degrees(F.acos(F.least(F.abs("az"), F.lit(1.0)))).alias("slope"), F.sqrt(F.greatest("l0", F.lit(0.0))).alias("roughness"),
        F.when(trace > 0, F.abs(F.col("l0") / trace)).otherwise(F.lit(0.0)).alias("curvature"), *[(F.col(a) * up).alias(n) for a, n in (("ax", "nx"), ("ay", "ny"), ("az", "nz"))],
    )
