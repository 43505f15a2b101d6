"""Typed configuration with defaults, read from YAML. Missing keys keep defaults; odd values are mended with a warning,
contradictions raise."""

from __future__ import annotations

import dataclasses
import math
import warnings
from dataclasses import dataclass, field
from typing import Any

from ..functions.sensors import SENSORS, Constant, Lidar, Rgbd, Sensor
from ..operators.estimate import P2, Kalman, Visibility

MODES = ("local", "global")
ESTIMATORS = ("kalman_filter", "p2_quantile")


def chosen(value: Any, known: tuple[str, ...], default: str) -> str:
    v = str(value).lower()
    if v not in known:
        warnings.warn(f"{value!r} is none of {', '.join(known)}; {default} is used", stacklevel=3)
        return default
    return v


def positive(value: float, default: float, name: str) -> float:
    if value > 0:
        return value
    warnings.warn(f"{name} must be positive; {default} is used", stacklevel=3)
    return default


def mended(value: Any, name: str, **rules: tuple[Any, float]) -> Any:
    """value with each field that its rule finds odd replaced, and said so. rules: a test of sound values, and what takes an odd one's place."""
    odd = {f: new for f, (sound, new) in rules.items() if hasattr(value, f) and not sound(getattr(value, f))}
    for f, new in odd.items():
        warnings.warn(f"{name}.{f} ({getattr(value, f)}) is out of range; {new} is used", stacklevel=4)
    return dataclasses.replace(value, **odd) if odd else value


def above(v: float) -> bool:
    return v > 0


def not_below(v: float) -> bool:
    return v >= 0


#: What takes the place of odd values. (fixed values)
KALMAN_RULES = {"min_variance": (above, 1e-4), "process_noise": (not_below, 0.0)}
RAY_RULES = {"threshold": (above, 0.05), "observed": (above, 0.4), "ghost": (above, 0.2), "most": (above, 2.0), "clear": (lambda v: v < 0, -1.0)}
SENSOR_RULES = {"range_noise": (above, 0.02), "angular_noise": (not_below, 0.0), "sigma": (above, 0.1), "a": (not_below, 0.0), "b": (not_below, 0.0), "c": (not_below, 0.0), "lateral": (not_below, 0.0)}


@dataclass(frozen=True)
class PointFilter:
    z_low: float = -math.inf
    z_high: float = math.inf
    range_low: float = 0.0
    range_high: float = math.inf


@dataclass(frozen=True)
class Raycasting:
    enabled: bool = False
    visibility: Visibility = Visibility()

    def __post_init__(self) -> None:
        if self.enabled:
            object.__setattr__(self, "visibility", mended(self.visibility, "raycasting", **RAY_RULES))


@dataclass(frozen=True)
class Mapping:
    mode: str = "local"
    estimator: str = "kalman_filter"
    kalman: Kalman = Kalman()
    p2: P2 = P2()
    sensor: Sensor = Lidar()
    point_filter: PointFilter = PointFilter()
    raycasting: Raycasting = Raycasting()
    length_x: float = 15.0
    length_y: float = 15.0
    resolution: float = 0.1

    def __post_init__(self) -> None:
        if self.kalman.min_variance >= self.kalman.max_variance:
            raise ValueError("the least variance must be below the greatest")
        object.__setattr__(self, "kalman", mended(self.kalman, "kalman", **KALMAN_RULES))
        p2 = mended(self.p2, "p2", marker=(lambda v: 0 <= v <= 4, min(4, max(0, self.p2.marker))), quantiles=(lambda q: all(0 <= v <= 1 for v in q), tuple(min(1.0, max(0.0, v)) for v in self.p2.quantiles)))
        object.__setattr__(self, "p2", p2)
        object.__setattr__(self, "sensor", mended(self.sensor, "sensor", **SENSOR_RULES))
        for name in ("length_x", "length_y", "resolution"):
            object.__setattr__(self, name, positive(getattr(self, name), type(self).__dataclass_fields__[name].default, name))
        object.__setattr__(self, "mode", chosen(self.mode, MODES, "local"))
        object.__setattr__(self, "estimator", chosen(self.estimator, ESTIMATORS, "kalman_filter"))


@dataclass(frozen=True)
class Postprocess:
    inpaint: bool = False
    passes: int = 3
    min_valid: int = 2
    fuse: bool = False
    fusion_radius: float = 0.15
    fusion_sigma: float = 0.05
    quantile_low: float = 0.01
    quantile_high: float = 0.99
    fusion_min_valid: int = 3
    features: bool = False
    feature_radius: float = 0.3
    feature_min_valid: int = 4
    step_low: float = 0.05
    step_high: float = 0.95

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if f.type in ("int", "float") and f.name not in ("quantile_low", "step_low"):
                object.__setattr__(self, f.name, max(1, v) if f.type == "int" else positive(v, f.default, f.name))
        for low, high in (("quantile_low", "quantile_high"), ("step_low", "step_high")):
            if getattr(self, low) >= getattr(self, high):
                warnings.warn(f"{low} must be below {high}; defaults are used", stacklevel=3)
                for n in (low, high):
                    object.__setattr__(self, n, type(self).__dataclass_fields__[n].default)


@dataclass(frozen=True)
class Node:
    """What a streaming job reads and how often it publishes (Hz)."""

    topics: tuple[str, ...] = ("points",)
    local_rate: float = 10.0
    global_rate: float = 1.0
    post_rate: float = 2.0
    most_stale: float = 0.1
    mapping: Mapping = field(default_factory=Mapping)
    post: Postprocess = field(default_factory=Postprocess)

    def __post_init__(self) -> None:
        if not self.topics or not all(self.topics):
            raise ValueError("a node needs topics with names")
        if min(self.local_rate, self.global_rate, self.post_rate) <= 0:
            raise ValueError("rates must be positive")


def of(kind: type, values: dict[str, Any] | None) -> Any:
    """A dataclass from a mapping: unknown keys are ignored, nested ones read alike."""
    made: dict[str, Any] = {}
    defaults = {f.name: f for f in dataclasses.fields(kind)}
    for k, v in (values or {}).items():
        if k not in defaults:
            continue
        if k == "sensor":
            options = dict(v) if isinstance(v, dict) else {"type": v}
            name = chosen(options.pop("type", "lidar"), tuple(SENSORS), "lidar")
            model = SENSORS[name]
            v = model(**{a: b for a, b in options.items() if a in model.__dataclass_fields__})
        elif isinstance(v, dict):
            d = defaults[k]
            v = of(type(d.default) if d.default is not dataclasses.MISSING else d.default_factory, v)
        elif isinstance(v, list):
            v = tuple(v)
        made[k] = v
    return kind(**made)


def load(path: str, kind: type = Node) -> Any:
    import yaml

    with open(path, encoding="utf-8") as f:
        return of(kind, yaml.safe_load(f))


__all__ = ["Constant", "Mapping", "Node", "PointFilter", "Postprocess", "Raycasting", "Rgbd", "load", "of"]
