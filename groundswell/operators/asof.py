"""Poses at times: as-of joins with interpolation, dimension lookup of extrinsics, path length, and deskewing.

Poses (by, ts, tx, ty, tz, qx, qy, qz, qw; ts in seconds) and queries meet in one union sorted by time within `by`, the
trajectory they belong to; two windows carry the pose before and the pose after to each query. No pair is ever made.
A trajectory is cut into ranges of time of about equal numbers of rows, whose windows run side by side; what a range
lacks at its ends comes from the first and last poses of the ranges around it, a row each. So one trajectory of any
length is spread over all tasks. Rows without a trajectory (null in by) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import XYZ, rotation_of, with_slerped
from ..plans.tables import stored

POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def lookup(points: DataFrame, extrinsics: DataFrame, key: str = "frame_id") -> DataFrame:
    """Points with their frame's extrinsic; points of unknown frames are left out. Catalyst broadcasts what it knows to be small."""
    return points.join(extrinsics, key)


def poses_at(queries: DataFrame, poses: DataFrame, by: tuple[str, ...] = (), clamp: bool = True, most_stale: float | None = None, columns: tuple[str, ...] = POSE) -> DataFrame:
    """queries (by, ts, ...) with the pose at ts: linear translation, spherical rotation between the poses around it.

    clamp: before the first and after the last pose that one holds; else those queries are left out. most_stale: a
    query is left out if the nearer pose around it is farther in time.
    """
    pose = F.struct(F.col("ts").alias("t"), *columns)
    extra = [c for c in queries.columns if c not in (*by, "ts")]
    q = queries.select(*by, "ts", F.lit(1).alias("__kind"), F.struct(*extra, F.lit(0).alias("__")).alias("__row"), F.lit(None).cast(poses.select(pose.alias("p")).schema["p"].dataType).alias("__pose"))
    p = poses.select(*by, "ts", F.lit(0).alias("__kind"), F.lit(None).cast(q.schema["__row"].dataType).alias("__row"), pose.alias("__pose"))
    both = cut_by_time(q.unionByName(p).dropna(subset=[*by, "ts"]), by)
    keys = ["__part", *by]
    before = Window.partitionBy(*keys).orderBy("ts", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("ts"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    when = F.when(F.col("__kind") == 0, F.col("ts"))
    ends = both.groupBy(*keys).agg(F.max_by("__pose", when).alias("__last"), F.min_by("__pose", when).alias("__first"))
    others = Window.partitionBy(*by).orderBy("__part")  # a row for each range of time
    ends = ends.select(*keys, F.last("__last", ignorenulls=True).over(others.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("__first", ignorenulls=True).over(others.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    met = both.withColumns({"__a": F.last("__pose", ignorenulls=True).over(before), "__b": F.last("__pose", ignorenulls=True).over(after)}).where("__kind = 1")
    met = met.join(ends, keys).withColumns({"__a": F.coalesce("__a", "__before"), "__b": F.coalesce("__b", "__after")})
    if not clamp:
        met = met.where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    met = met.withColumns({"__a": F.coalesce("__a", "__b"), "__b": F.coalesce("__b", "__a")}).where(F.col("__a").isNotNull())
    if most_stale is not None:
        met = met.where(F.least(F.abs(F.col("ts") - F.col("__a.t")), F.abs(F.col("__b.t") - F.col("ts"))) <= most_stale)
    span = F.col("__b.t") - F.col("__a.t")
    met = met.withColumn("__u", F.when(span <= 0, F.lit(0.0)).otherwise(F.try_divide(F.col("ts") - F.col("__a.t"), span)))
    turn = ("qx", "qy", "qz", "qw")
    if set(turn) <= set(columns):
        met = with_slerped(met, [F.col(f"__a.{c}") for c in turn], [F.col(f"__b.{c}") for c in turn], F.col("__u"), turn)
    else:
        turn = ()
    out = {c: F.col(f"__a.{c}") + F.col("__u") * (F.col(f"__b.{c}") - F.col(f"__a.{c}")) for c in columns if c not in turn}
    return met.withColumns(out).select(*by, "ts", *[F.col(f"__row.{c}").alias(c) for c in extra], *columns)


def cut_by_time(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows (by, ts, ...) with __part, a range of (by, ts) of about as many rows as any other; equal times share one."""
    return stored(rows.repartitionByRange(*by, "ts").withColumn("__part", F.spark_partition_id()), "by-time")


def moved(points: DataFrame, pose: tuple[str, ...] = POSE, turn: list[Column] | None = None) -> DataFrame:
    """Points moved by the pose in their own row. turn: the pose's rotation, row by row, where a column holds it already."""
    r = turn or rotation_of([F.col(c) for c in pose[3:]])
    v = [F.col(c) for c in XYZ]
    out = {c: r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] + F.col(pose[i]) for i, c in enumerate(XYZ)}
    if {"nx", "ny", "nz"} <= set(points.columns):
        n = [F.col(c) for c in ("nx", "ny", "nz")]
        out |= {c: r[3 * i] * n[0] + r[3 * i + 1] * n[1] + r[3 * i + 2] * n[2] for i, c in enumerate(("nx", "ny", "nz"))}
    return points.withColumns(out)


def trajectory_stats(poses: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """length (of the path), duration, start and end of each trajectory: steps within ranges of time, then those between them."""
    place = ("tx", "ty", "tz")
    rows = cut_by_time(poses.select(*by, "ts", *place).dropna(subset=[*by, "ts"]), by)
    keys = ["__part", *by]
    far = lambda old, new: F.sqrt(sum(((n - o) * (n - o) for o, n in zip(old, new, strict=True)), F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("ts")
    way = rows.withColumn("__step", far([F.lag(c).over(w) for c in place], [F.col(c) for c in place]))
    here = F.struct("ts", *place)
    ends = way.groupBy(*keys).agg(F.sum("__step").alias("__length"), F.min(here).alias("__first"), F.max(here).alias("__last"))
    last = F.lag("__last").over(Window.partitionBy(*by).orderBy("__part"))  # a row for each range of time
    ends = ends.withColumn("__old", last)
    ends = ends.withColumn("__between", far([F.col(f"__old.{c}") for c in place], [F.col(f"__first.{c}") for c in place]))
    length = F.sum(F.coalesce("__length", F.lit(0.0)) + F.coalesce("__between", F.lit(0.0)))
    return ends.groupBy(*by).agg(length.alias("length"), (F.max("__last.ts") - F.min("__first.ts")).alias("duration"), F.min("__first.ts").alias("start_ts"), F.max("__last.ts").alias("end_ts"))


def sweep_share(points: DataFrame, mode: str = "channel", by: tuple[str, ...] = ("scan_id",), start: float | None = None, end: float | None = None) -> DataFrame:
    """points with alpha, their place in the sweep from 0 to 1: by the time channel's bounds, by order, or between given times."""
    if mode == "index":
        w = Window.partitionBy(*by)
        n = F.count(F.lit(1)).over(w)
        at = F.row_number().over(w.orderBy("point_id")) - 1
        return points.withColumn("alpha", F.when(n > 1, at / (n - 1)).otherwise(F.lit(0.0)))
    if "t" not in points.columns:
        raise ValueError("deskewing by time needs the channel t")
    if start is None or end is None:
        bounds = points.groupBy(*by).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
        points = points.join(bounds, list(by))
    else:
        points = points.withColumns({"__lo": F.lit(start), "__hi": F.lit(end)})
    span = F.col("__hi") - F.col("__lo")
    share = F.when(F.abs(span) < 1e-9, F.lit(1.0)).otherwise(F.try_divide(F.col("t") - F.col("__lo"), span))  # no span, no motion
    return points.withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).drop("__lo", "__hi")


def deskewed(points: DataFrame, start: list[Column], end: list[Column], mode: str = "channel", **options: object) -> DataFrame:
    """Points as if all were measured at the sweep's end: each moves by end^-1 * pose(alpha). Poses: tx, ty, tz, qx, qy, qz, qw."""
    share = sweep_share(points, mode, **options)
    alpha = F.col("alpha")
    names = ("__qx", "__qy", "__qz", "__qw")
    share = with_slerped(share, start[3:], end[3:], alpha, names)
    r = rotation_of([F.col(n) for n in names])
    v = [F.col(c) for c in XYZ]
    world = [r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] + start[i] + alpha * (end[i] - start[i]) - end[i] for i in range(3)]
    back = rotation_of(end[3:])
    into = lambda w: [back[i] * w[0] + back[3 + i] * w[1] + back[6 + i] * w[2] for i in range(3)]
    out = dict(zip(XYZ, into(world), strict=True))
    if {"nx", "ny", "nz"} <= set(points.columns):
        n = [F.col(c) for c in ("nx", "ny", "nz")]
        out |= dict(zip(("nx", "ny", "nz"), into([r[3 * i] * n[0] + r[3 * i + 1] * n[1] + r[3 * i + 2] * n[2] for i in range(3)]), strict=True))
    return share.withColumns(out).drop("alpha", *names)


def deskewed_along(points: DataFrame, poses: DataFrame, by: tuple[str, ...] = ("scan_id",), start: Column | None = None, trajectory: tuple[str, ...] = (), clamp: bool = True) -> DataFrame:
    """Points as if all were measured at the sweep's end, each moved by end^-1 * pose(its time): poses come from a trajectory.

    A point's time is t, from `start` of its scan (0 where none is given) on; a scan's end is the time of its last point.
    Points without a pose are left out; so are all of a scan whose end has none.
    """
    if "t" not in points.columns:
        raise ValueError("deskewing along a trajectory needs the channel t")
    timed = points.withColumn("ts", (start if start is not None else F.lit(0.0)) + F.col("t"))
    ends = timed.groupBy(*dict.fromkeys((*by, *trajectory))).agg(F.max("ts").alias("ts"))
    end = [f"e{c}" for c in POSE]
    at_end = poses_at(ends, poses, trajectory, clamp).select(*by, *[F.col(c).alias(e) for c, e in zip(POSE, end, strict=True)])
    met = poses_at(timed, poses, trajectory, clamp).join(at_end, list(by))
    out = moved(met)  # in the trajectory's frame; then into that of the scan's end
    back = rotation_of([F.col(e) for e in end[3:]])
    into = lambda v: [back[i] * v[0] + back[3 + i] * v[1] + back[6 + i] * v[2] for i in range(3)]
    columns = dict(zip(XYZ, into([F.col(c) - F.col(e) for c, e in zip(XYZ, end, strict=False)]), strict=True))
    normal = ("nx", "ny", "nz")
    if set(normal) <= set(points.columns):
        columns |= dict(zip(normal, into([F.col(c) for c in normal]), strict=True))
    return out.withColumns(columns).select(points.columns)


__all__ = ["POSE", "deskewed", "deskewed_along", "lookup", "moved", "poses_at", "sweep_share", "trajectory_stats"]
