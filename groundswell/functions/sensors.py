"""Measurement covariances of points in the sensor's frame, as six columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .geometry import COVARIANCE


def diagonal(a: Column, b: Column, c: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return dict(zip(COVARIANCE, (a, zero, zero, b, zero, c), strict=True))


@dataclass(frozen=True)
class Constant:
    sigma: float = 0.03

    def covariance(self) -> dict[str, Column]:
        v = F.lit(self.sigma * self.sigma)
        return diagonal(v, v, v)


@dataclass(frozen=True)
class Lidar:
    """Range noise along the beam, angular noise across it."""

    range_noise: float = 0.02
    angular_noise: float = 0.001

    def covariance(self) -> dict[str, Column]:
        p = [F.col(c) for c in "xyz"]
        r2 = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
        along = F.lit(max(self.range_noise**2, 1e-6))
        across = F.greatest(r2 * F.lit(self.angular_noise**2), F.lit(1e-6))
        out = {}
        for name, (i, j) in zip(COVARIANCE, ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), strict=True):
            value = (along - across) * F.try_divide(p[i] * p[j], r2) + (across if i == j else F.lit(0.0))
            out[name] = F.when(r2 < 1e-6, F.lit(0.01 if i == j else 0.0)).otherwise(value)
        return out


@dataclass(frozen=True)
class Rgbd:
    """Noise along the optical axis grows with the square of the distance from the best depth."""

    a: float = 0.001
    b: float = 0.002
    c: float = 0.4
    lateral: float = 0.001

    def covariance(self) -> dict[str, Column]:
        d = F.col("z")
        normal = F.lit(self.a) + F.lit(self.b) * (d - self.c) * (d - self.c)
        side = F.when(d <= 0, F.lit(0.01)).otherwise(F.lit(self.lateral) * d * F.lit(self.lateral) * d)
        return diagonal(side, side, F.when(d <= 0, F.lit(0.01)).otherwise(normal * normal))


@dataclass(frozen=True)
class Custom:
    """A user's own model: a function that returns the six columns by name."""

    columns: Callable[[], dict[str, Column]]

    def covariance(self) -> dict[str, Column]:
        return self.columns()


Sensor = Constant | Lidar | Rgbd | Custom
SENSORS: dict[str, type] = {"constant": Constant, "none": Constant, "lidar": Lidar, "laser": Lidar, "rgbd": Rgbd}


def sensor(kind: str, **options: float) -> Sensor:
    """A model by name; unknown names mean lidar."""
    return SENSORS.get(kind.lower(), Lidar)(**options)


def with_covariance(points: DataFrame, model: Sensor) -> DataFrame:
    return points.withColumns(model.covariance())
