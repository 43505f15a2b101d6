"""Row filters on points. Comparisons are false for null and NaN, so unmeasured points pass no crop, inside or outside."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def where(points: DataFrame, predicate: Column) -> DataFrame:
    return points.where(predicate)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def remove_invalid(points: DataFrame) -> DataFrame:
    return points.where(finite("x") & finite("y") & finite("z"))


def either(measured: Column, inside: Column, outside: bool) -> Column:
    return measured & ~inside if outside else measured & inside


def real(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n)
    return out


def crop_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], outside: bool = False) -> DataFrame:
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside & F.col(c).between(a, b)
    return points.where(either(real("x", "y", "z"), inside, outside))


def crop_axis(points: DataFrame, axis: str, low: float, high: float, outside: bool = False) -> DataFrame:
    return points.where(either(real(axis), F.col(axis).between(low, high), outside))


def crop_range(points: DataFrame, low: float, high: float, outside: bool = False) -> DataFrame:
    """By distance from the origin. Inside, each axis is bounded as well, which a Parquet scan can use."""
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    out = points.where(either(real("x", "y", "z"), square.between(low * low, high * high), outside))
    if not outside:
        for c in "xyz":
            out = out.where(F.col(c).between(-high, high))
    return out


def in_angle(low: float, high: float) -> Column:
    """Azimuth from low counter-clockwise to high (radians), by cross products, with a little slack."""
    past_low = F.lit(math.cos(low)) * F.col("y") - F.lit(math.sin(low)) * F.col("x") >= -1e-5
    before_high = F.lit(math.sin(high)) * F.col("x") - F.lit(math.cos(high)) * F.col("y") >= -1e-5
    span = high - low + (2 * math.pi if low > high else 0)
    return past_low & before_high if span < math.pi else past_low | before_high


def crop_angle(points: DataFrame, low: float, high: float, outside: bool = False) -> DataFrame:
    return points.where(either(real("x", "y"), in_angle(low, high), outside))


def point_filter(points: DataFrame, z_low: float = -math.inf, z_high: float = math.inf, range_low: float = 0.0, range_high: float = math.inf) -> DataFrame:
    """The mapping pipeline's filter, in the base frame: range, then height."""
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return points.where(square.between(range_low**2, range_high**2) & F.col("z").between(z_low, z_high) & real("x", "y", "z"))
