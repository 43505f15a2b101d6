"""From scans to a map: the whole pipeline as one logical plan.

points (scan_id, scan_ts, frame_id, x, y, z, ... in the sensor's frame) meet their frame's extrinsic and the pose at
their scan's time; covariances, range and height filters, cells; then each cell folds its scans in order. A local map
drops a cell's state whenever the window of any scan since left it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import Grid, rotation_of
from ..functions.sensors import Sensor, with_covariance
from ..operators import estimate, stencil
from ..operators.asof import POSE, lookup, moved, poses_at
from ..operators.filters import point_filter
from ..operators.raster import CELL, rasterized
from ..operators.raycast import evidence
from .config import Mapping, PointFilter, Postprocess, Raycasting
from .tables import stored

Observer = Callable[[DataFrame], None]


@dataclass(frozen=True)
class Mapper:
    """Immutable; the with_ methods return changed copies."""

    config: Mapping = field(default_factory=Mapping)
    extrinsics: DataFrame | None = None
    poses: DataFrame | None = None
    most_stale: float | None = 0.1
    on_preprocessed: Observer | None = None
    on_rasterized: Observer | None = None
    slice_scans: int = 20_000  # scans that a cell's fold takes at once

    def _set(self, **changes: object) -> Mapper:
        return dataclasses.replace(self, config=dataclasses.replace(self.config, **changes))

    def with_mode(self, mode: str) -> Mapper:
        return self._set(mode=mode)

    def with_estimator(self, estimator: str) -> Mapper:
        return self._set(estimator=estimator)

    def with_sensor(self, sensor: Sensor) -> Mapper:
        return self._set(sensor=sensor)

    def with_height_filter(self, low: float, high: float) -> Mapper:
        return self._set(point_filter=dataclasses.replace(self.config.point_filter, z_low=low, z_high=high))

    def with_range_filter(self, low: float, high: float) -> Mapper:
        return self._set(point_filter=dataclasses.replace(self.config.point_filter, range_low=low, range_high=high))

    def with_raycasting(self, enabled: bool = True, **options: float) -> Mapper:
        return self._set(raycasting=Raycasting(enabled, estimate.Visibility(**options)))

    def with_providers(self, extrinsics: DataFrame, poses: DataFrame, most_stale: float | None = 0.1) -> Mapper:
        return dataclasses.replace(self, extrinsics=extrinsics, poses=poses, most_stale=most_stale)

    @property
    def grid(self) -> Grid:
        return Grid(self.config.length_x, self.config.length_y, self.config.resolution, unbounded=self.config.mode == "local" and self.poses is not None)

    def preprocessed(self, points: DataFrame) -> DataFrame:
        """Points in the map frame with czz, after the filters in the base frame. Scans without extrinsic or pose are left out."""
        filters: PointFilter = self.config.point_filter
        p = with_covariance(points, self.config.sensor)
        # Rotations are columns of the small tables, a row a frame or a scan, so that what runs for each point stays short.
        base, turn_b, turn = [f"b{c}" for c in POSE], [f"__b{i}" for i in range(9)], [f"__r{i}" for i in range(9)]
        if self.extrinsics is not None:
            frames = self.extrinsics.select("frame_id", *[F.col(c).alias(b) for c, b in zip(POSE, base, strict=True)])
            p = lookup(p, self._turned(frames, base, turn_b))
        else:
            p = self._turned(p.withColumns({b: F.lit(1.0 if b == "bqw" else 0.0) for b in base}), base, turn_b)
        p = point_filter(moved(p, tuple(base), [F.col(c) for c in turn_b]), filters.z_low, filters.z_high, filters.range_low, filters.range_high)
        if self.poses is not None:
            scans = points.select("scan_id", F.col("scan_ts").alias("ts")).distinct()
            placed = poses_at(scans, self.poses, most_stale=self.most_stale).drop("ts")
            p = p.join(stored(self._turned(placed, POSE, turn), "placed"), "scan_id")
        else:
            p = self._turned(p.withColumns({c: F.lit(1.0 if c == "qw" else 0.0) for c in POSE}), POSE, turn)
        p = self._upright(p, turn, turn_b).withColumns(self._sensor_place(base, turn))
        p = moved(p, turn=[F.col(c) for c in turn]).drop(*base, *turn_b, *POSE, *turn)
        if self.on_preprocessed:
            self.on_preprocessed(p)
        return p

    @staticmethod
    def _turned(rows: DataFrame, pose: Sequence[str], names: list[str]) -> DataFrame:
        return rows.withColumns(dict(zip(names, rotation_of([F.col(c) for c in pose[3:]]), strict=True)))

    @staticmethod
    def _upright(p: DataFrame, turn: list[str], turn_b: list[str]) -> DataFrame:
        """p with czz, the height variance in the map frame: the last row of both rotations around the sensor's covariance."""
        a, b = [F.col(c) for c in turn], [F.col(c) for c in turn_b]
        up = [f"__up{j}" for j in range(3)]
        p = p.withColumns({up[j]: a[6] * b[j] + a[7] * b[3 + j] + a[8] * b[6 + j] for j in range(3)})
        r, c = [F.col(u) for u in up], {k: F.col(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
        return p.withColumn("czz", r[0] * r[0] * c["xx"] + r[1] * r[1] * c["yy"] + r[2] * r[2] * c["zz"] + 2 * (r[0] * r[1] * c["xy"] + r[0] * r[2] * c["xz"] + r[1] * r[2] * c["yz"])).drop(*up)

    @staticmethod
    def _sensor_place(base: list[str], turn: list[str]) -> dict[str, Column]:
        r, t = [F.col(c) for c in turn], [F.col(b) for b in base[:3]]
        return {o: r[3 * i] * t[0] + r[3 * i + 1] * t[1] + r[3 * i + 2] * t[2] + F.col(POSE[i]) for i, o in enumerate(("ox", "oy", "oz"))} | {"wx": F.col("tx"), "wy": F.col("ty")}

    def facts(self, prepared: DataFrame) -> DataFrame:
        facts = rasterized(prepared, self.grid)
        if self.on_rasterized:
            self.on_rasterized(facts)
        return facts

    def windows(self, prepared: DataFrame) -> DataFrame:
        """scan_id, wr, wc (the window's place, in cells) and nth: a row for each scan, in order. A window moves by whole cells."""
        res, mid_r, mid_c = self.config.resolution, self.grid.rows // 2, self.grid.cols // 2
        at = prepared.groupBy(F.col("scan_id").cast("long").alias("scan_id")).agg((mid_r - F.round(F.first("wx") / res)).cast("long").alias("wr"), (mid_c - F.round(F.first("wy") / res)).cast("long").alias("wc"))
        return stored(at.withColumn("nth", F.row_number().over(Window.orderBy("scan_id"))), "windows")

    @property
    def half(self) -> tuple[int, int]:
        """Half a window, in cells: it reaches so far up and, less one, down."""
        return round(self.config.length_x / self.config.resolution) // 2, round(self.config.length_y / self.config.resolution) // 2

    def kept(self, at: DataFrame) -> tuple[int, int, int, int] | None:
        """The rows and columns (first and last, both) that lie in all of the windows; none without windows."""
        b = at.agg(F.min("wr"), F.max("wr"), F.min("wc"), F.max("wc")).first()
        if b[0] is None:
            return None
        (half_r, half_c), (lo_r, hi_r, lo_c, hi_c) = self.half, b
        return hi_r - half_r, lo_r + half_r - 1, hi_c - half_c, lo_c + half_c - 1

    def windowed(self, cells: DataFrame, prepared: DataFrame, at: DataFrame | None = None, before: bool = False) -> DataFrame:
        """For a local map of the configured size around the robot: cells inside their scan's window, with reset where
        a window in between has left the cell, and a row without measurement after the last scan, with reset where a
        window since has left it. before: cells may have states from before the first scan, whose windows count as well."""
        half_r, half_c = self.half
        at = self.windows(prepared) if at is None else at
        inside = (F.col("row") - F.col("wr")).between(-half_r, half_r - 1) & (F.col("col") - F.col("wc")).between(-half_c, half_c - 1)
        met = cells.withColumn("scan_id", F.col("scan_id").cast("long")).join(at, "scan_id").where(inside).select(*cells.columns, "nth")
        end = at.agg((F.max("scan_id") + 1).alias("scan_id"), (F.max("nth") + 1).alias("nth"))  # one row: after the last scan
        met = met.unionByName(met.select(*CELL).distinct().join(F.broadcast(end)), allowMissingColumns=True)
        met = met.withColumn("first", F.coalesce(F.lag("nth").over(Window.partitionBy(*CELL).orderBy("nth")) + 1, F.lit(1) if before else F.lit(None))).withColumn("between", F.col("nth") - F.col("first"))
        # The windows in between are bounded by those of two runs of scans, each a power of two long, that cover them.
        spans = window_spans(at)
        power = F.floor(F.log2(F.col("between"))).cast("int")
        met = met.withColumn("power", F.when(F.col("between") > 0, power))
        for k, start in enumerate((F.col("first"), F.col("nth") - F.expr("shiftleft(1, power)"))):
            s = spans.select(F.col("power"), F.col("nth").alias(f"at{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("lo_r", "hi_r", "lo_c", "hi_c")])
            met = met.withColumn(f"at{k}", start).join(s, ["power", f"at{k}"], "left")
        lo = {c: F.least(f"lo_{c}0", f"lo_{c}1") for c in "rc"}
        hi = {c: F.greatest(f"hi_{c}0", f"hi_{c}1") for c in "rc"}
        stayed = (F.col("row") >= hi["r"] - half_r) & (F.col("row") <= lo["r"] + half_r - 1) & (F.col("col") >= hi["c"] - half_c) & (F.col("col") <= lo["c"] + half_c - 1)
        return met.withColumn("reset", F.coalesce(~stayed, F.lit(False))).select(*cells.columns, "reset")

    @property
    def is_local(self) -> bool:
        return self.config.mode == "local" and self.poses is not None

    def events(self, prepared: DataFrame, facts: DataFrame, at: DataFrame | None = None, before: bool = False) -> DataFrame:
        """All that scans say of cells, for the fold."""
        more = {"max_z": "high", "max_intensity": "intensity", "color": "color"}
        extras = [F.col(c).alias(n) for c, n in more.items() if c in facts.columns]
        if self.config.raycasting.enabled:
            cells = evidence(facts, voxel_grid_by_scan(prepared, self.config.resolution), self.grid, extras)
        else:
            cells = facts.select(F.col("scan_id").cast("long").alias("scan_id"), *CELL, F.col("min_z").alias("z"), F.col("min_z_var").alias("variance"), *extras)
        return self.windowed(cells, prepared, at, before) if self.is_local else cells

    def folded(self, cells: DataFrame, start: str | None = None) -> DataFrame:
        """row, col, state after cells, by the configured estimator."""
        rays = self.config.raycasting
        seen = rays.visibility if rays.enabled else None
        if self.config.estimator == "p2_quantile":
            return estimate.p2_states(cells, self.config.p2, seen, start=start)
        return estimate.fold(cells, self.config.kalman, seen, start=start)

    def layers(self, states: DataFrame, last: int | None) -> DataFrame:
        if self.config.estimator == "p2_quantile":
            return estimate.p2_layers(states, self.config.p2, last=last)
        return estimate.layers(states, last=last)

    def mapped(self, points: DataFrame) -> DataFrame:
        """The map's layers after all scans, in order of scan_id."""
        prepared = self.preprocessed(points)
        facts = stored(self.facts(prepared), "facts")  # read several times below; points are not, but for rays
        last = facts.agg(F.max("scan_id").cast("long")).first()[0]
        states = estimate.in_slices(self.events(prepared, facts), self.folded, self.slice_scans)
        return self.layers(states, last)


def window_spans(at: DataFrame) -> DataFrame:
    """power, nth, and the bounds of window places over the 2**power scans from nth on."""
    count = at.count()
    now = at.select(F.lit(0).alias("power"), "nth", *[F.col(w).alias(n) for w, ns in (("wr", ("lo_r", "hi_r")), ("wc", ("lo_c", "hi_c"))) for n in ns])
    out = now
    power = 0
    while 1 << (power := power + 1) <= count:
        half = 1 << (power - 1)
        right = now.select((F.col("nth") - half).alias("nth"), *[F.col(c).alias(f"{c}_") for c in ("lo_r", "hi_r", "lo_c", "hi_c")])
        joined = now.join(right, "nth")
        now = stored(joined.select(F.lit(power).alias("power"), "nth", *[(F.least if c.startswith("lo") else F.greatest)(c, f"{c}_").alias(c) for c in ("lo_r", "hi_r", "lo_c", "hi_c")]), "spans")  # else each level would plan the one before twice
        out = out.union(now)
    return out


def voxel_grid_by_scan(points: DataFrame, size: float) -> DataFrame:
    """One point (the smallest id) of each scan and voxel."""
    from ..operators.voxel import VOXEL, voxelled

    chosen = F.min_by(F.struct("x", "y", "z", "ox", "oy", "oz"), "point_id").alias("p")
    return voxelled(points, size).groupBy("scan_id", *VOXEL).agg(chosen).select("scan_id", "p.*")


def postprocessed(cells: DataFrame, grid: Grid, config: Postprocess) -> DataFrame:
    """Fusion of bounds, then holes filled, then terrain features, as asked for."""
    out = cells
    if config.fuse:
        fused = stencil.fused_uncertainty(out, grid.resolution, config.fusion_radius, config.fusion_sigma, config.quantile_low, config.quantile_high, config.fusion_min_valid)
        out = out.drop("lower_bound", "upper_bound").join(fused, list(CELL), "left")
    if config.inpaint:
        out = stencil.inpainted(out, grid, config.passes, config.min_valid).join(out.drop("elevation"), list(CELL), "left")
    if config.features:
        out = out.join(stencil.terrain_features(out, grid.resolution, config.feature_radius, config.feature_min_valid, config.step_low, config.step_high), list(CELL), "left")
    return out


__all__ = ["Mapper", "postprocessed", "voxel_grid_by_scan"]
