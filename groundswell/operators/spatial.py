"""Range and nearest-neighbour joins in space: cells of the radius's size make an equi-join, distances settle the rest.

Each left row goes to the 27 cells around it, each right row to its own, so a pair meets exactly once and no side is
broadcast. Nearest neighbours begin with cells as fine as the points around a row are dense, level by level halved, and
widen the radius for those rows alone that are not settled yet.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import cell
from ..plans.tables import stored
from .filters import remove_invalid

CELLS = ("kx", "ky", "kz")
LEVEL = ("level", *CELLS)
#: Cells are halved so often at most.
FINEST = 24


def distance2(a: str, b: str) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def within(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Pairs src_id, dst_id, dist_sq of left and right points (point_id, x, y, z) no farther apart than the radius."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    a = left.select(F.col("point_id").alias("src_id"), *[F.col(c).alias(f"a{c}") for c in "xyz"]).withColumn("o", F.explode(around))
    a = a.withColumns({k: cell(F.col(f"a{c}"), radius) + F.col(f"o.{o}") for k, c, o in zip(CELLS, "xyz", "ijk", strict=True)}).drop("o")
    b = right.select(F.col("point_id").alias("dst_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    b = b.withColumns({k: cell(F.col(f"b{c}"), radius) for k, c in zip(CELLS, "xyz", strict=True)})
    d2 = distance2("a", "b")
    met = a.join(b, list(CELLS)).withColumn("dist_sq", d2)
    return met.where(F.col("dist_sq") < radius * radius if strict else F.col("dist_sq") <= radius * radius).select("src_id", "dst_id", "dist_sq")


def cell_at(value: Column, side: float) -> Column:
    """The cell at a row's level: those of the side at level 0, of half of it at 1, of twice as much at -1."""
    return F.floor(value * F.lit(1.0 / side) * F.pow(F.lit(2.0), F.col("level"))).cast("long")


def at_levels(points: DataFrame, prefix: str, side: float, levels: Iterable[int]) -> DataFrame:
    """points once for each level, with their cell there; coordinates are named by the prefix."""
    out = points.withColumn("level", F.explode(F.array(*[F.lit(int(v)) for v in levels])))
    return out.withColumns({k: cell_at(F.col(f"{prefix}{c}"), side) for k, c in zip(CELLS, "xyz", strict=True)})


def halvings(points: DataFrame, prefix: str, side: float, most: float) -> int:
    """How often cells of the side are halved until a point shares its own with that many at most, on average, itself included."""
    for first in range(0, FINEST, 4):
        cells = at_levels(points, prefix, side, range(first, first + 4)).groupBy(*LEVEL).agg(F.count(F.lit(1)).cast("double").alias("n"))
        crowds = cells.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()
        for level, crowd in sorted(map(tuple, crowds)):
            if crowd <= most:
                return level
        if not crowds:
            return 0
    return FINEST


@dataclass(frozen=True)
class Places:
    """Where a cloud has points (dst_id: the smallest id there; bx, by, bz), and one of them for each cell of each level."""

    points: DataFrame
    marks: DataFrame
    side: float
    depth: int


_PLACES: WeakKeyDictionary[DataFrame, dict[float, Places]] = WeakKeyDictionary()


def places(target: DataFrame, max_distance: float) -> Places:
    known = _PLACES.setdefault(target, {})
    if max_distance not in known:
        named = remove_invalid(target).select("point_id", *[F.col(c).alias(f"b{c}") for c in "xyz"])
        points = stored(named.groupBy("bx", "by", "bz").agg(F.min("point_id").alias("dst_id")), "places")
        depth = halvings(points, "b", max_distance, 3.0)
        any_ = at_levels(points, "b", max_distance, range(depth + 1)).groupBy(*LEVEL).agg(F.min_by(F.struct("bx", "by", "bz"), "dst_id").alias("b"))
        known[max_distance] = Places(points, stored(any_.select(*LEVEL, "b.*"), "marks"), max_distance, depth)
    return known[max_distance]


def candidates(source: DataFrame, target: DataFrame, max_distance: float) -> DataFrame:
    """src_id, bound, dst_id, dist_sq: the target points among which a source point's nearest is, if it is nearer than the distance.

    Points that share a cell with a source point, at any level, bound the distance of the nearest; only cells that reach so far
    are looked at, of the level whose cells are just as large. What the target has is found out once for all calls.
    """
    there = places(target, max_distance)
    levels, far = range(there.depth + 1), max_distance * max_distance
    own = remove_invalid(source).select(F.col("point_id").alias("src_id"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    bound = F.least(F.coalesce(distance2("a", "b"), F.lit(far)), F.lit(far))
    seen = at_levels(own, "a", max_distance, levels).join(there.marks, list(LEVEL), "left").groupBy("src_id", "ax", "ay", "az").agg(F.min(bound).alias("bound"))
    # a trifle more than the bound, for what is lost in x - reach
    reach = F.sqrt("bound") * 1.000000001 + 1e-12 * (F.abs("ax") + F.abs("ay") + F.abs("az"))
    level = F.when(F.col("bound") > 0, F.least(F.lit(there.depth), F.greatest(F.lit(0), F.floor(F.log2(F.lit(max_distance) / F.sqrt("bound"))).cast("int")))).otherwise(F.lit(there.depth))
    near = seen.withColumns({"reach": reach, "level": level})
    for k, c in zip(CELLS, "xyz", strict=True):
        near = near.withColumn(k, F.explode(F.sequence(cell_at(F.col(f"a{c}") - F.col("reach"), max_distance), cell_at(F.col(f"a{c}") + F.col("reach"), max_distance))))
    return near.join(at_levels(there.points, "b", max_distance, levels), list(LEVEL)).withColumn("dist_sq", distance2("a", "b"))


def closest(source: DataFrame, target: DataFrame, max_distance: float) -> DataFrame:
    """src_id, dst_id: the nearest target point of each source point, if nearer than the distance, ties to the smaller id."""
    met = candidates(source, target, max_distance)
    met = met.where((F.col("dist_sq") <= F.col("bound")) & (F.col("dist_sq") < max_distance * max_distance))
    return met.groupBy("src_id").agg(F.min_by("dst_id", F.struct("dist_sq", "dst_id")).alias("dst_id"))


def begun(left: DataFrame, right: DataFrame, k: int, radius: float) -> DataFrame:
    """left with the level at which a search for k begins: the finest at which the own cell says that a ball as wide as the cell holds
    more than k points; cells of level 0 are as wide as the radius."""
    enough = max(2, -(-9 * (k + 1) // 25))  # a ball is 4.19 times its radius's cube; half as many again as are looked for
    b = right.select(*[F.col(c).alias(f"b{c}") for c in "xyz"])
    depth = halvings(b, "b", radius, enough)
    if not depth:
        return left.withColumn("level", F.lit(0))
    full = at_levels(b, "b", radius, range(1, depth + 1)).groupBy(*LEVEL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).drop("n")
    deep = at_levels(left, "", radius, range(1, depth + 1)).join(full, list(LEVEL), "left_semi").groupBy("point_id").agg(F.max("level").alias("level"))
    return left.join(deep, "point_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def within_levels(left: DataFrame, right: DataFrame, side: float, levels: list[int], most: float) -> DataFrame:
    """Pairs of left points with right points no farther apart than the side of their level's cells, nor than the most."""
    names = lambda df, p, i: [F.col("point_id").alias(i), *[F.col(c).alias(f"{p}{c}") for c in "xyz"]]
    a = left.select(*names(left, "a", "src_id"), "level").withColumn("radius", F.least(F.lit(side) * F.pow(F.lit(2.0), -F.col("level")), F.lit(most)))
    for k, c in zip(CELLS, "xyz", strict=True):
        a = a.withColumn(k, F.explode(F.sequence(cell_at(F.col(f"a{c}"), side) - 1, cell_at(F.col(f"a{c}"), side) + 1)))
    met = a.join(at_levels(right.select(*names(right, "b", "dst_id")), "b", side, levels), list(LEVEL)).withColumn("dist_sq", distance2("a", "b"))
    return met.where(F.col("dist_sq") <= F.col("radius") * F.col("radius")).select("src_id", "dst_id", "dist_sq")


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float | None = None, own: bool = True, max_distance: float | None = None) -> DataFrame:
    """src_id, rank, dst_id, dist_sq: the k nearest right points of each left point, nearest first, ties to the smaller id.

    radius is a first guess, else that of a ball which holds k points at the points' mean density; where points are denser, rows
    begin with a half of it, a quarter and so on. A row is settled once k points lie within the radius searched; the others go on
    with twice as much, until the radius spans all points.
    max_distance: only neighbours up to it count, and the search ends there.
    """
    bounds = lambda df, mark: df.agg(*(f(c).alias(f"{mark}{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))), F.count(F.lit(1)).alias(f"{mark}n")).first()
    here, there = bounds(left, ""), bounds(right, "q")
    if not here["n"] or not there["qn"]:
        return within(left, right, 1.0).withColumn("rank", F.lit(0)).select("src_id", "rank", "dst_id", "dist_sq").limit(0)
    reach = sum((max(here[f"hi{c}"], there[f"qhi{c}"]) - min(here[f"lo{c}"], there[f"qlo{c}"])) ** 2 for c in "xyz") ** 0.5
    if radius is None:
        sides = sorted((there[f"qhi{c}"] - there[f"qlo{c}"] for c in "xyz"), reverse=True)
        room = sides[0] * max(sides[1], sides[0] / 100) * max(sides[2], sides[0] / 100)
        radius = max((0.75 * room * (k + 1) / there["qn"]) ** (1 / 3), reach / 1000, 1e-9)
    end = reach if max_distance is None else min(reach, max_distance)
    most = max_distance if max_distance is not None else float("inf")
    open_, settled, done = stored(begun(left.select("point_id", "x", "y", "z"), right, k, radius), "begun"), [], 0
    order = Window.partitionBy("src_id").orderBy("dist_sq", "dst_id")
    while True:
        levels = [r[0] for r in open_.select("level").distinct().collect()]
        pairs = within_levels(open_, right, radius, levels, most)
        if not own:
            pairs = pairs.where("src_id <> dst_id")
        top = stored(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        last = open_.where(F.lit(radius) * F.pow(F.lit(2.0), -F.col("level")) >= end).select(F.col("point_id").alias("src_id"))
        full = stored(top.where(F.col("rank") == k).select("src_id").union(last).distinct(), "settled")
        settled.append(top.join(full, "src_id", "left_semi"))
        done += full.count()
        if done >= here["n"]:
            break
        open_ = stored(open_.join(full, open_["point_id"] == full["src_id"], "left_anti").withColumn("level", F.col("level") - 1), "open")
        if not open_.take(1):
            break
    out = settled[0].select("src_id", "rank", "dst_id", "dist_sq")
    for more in settled[1:]:
        out = out.union(more.select(out.columns))
    return out


def radius_outliers_removed(points: DataFrame, radius: float, min_neighbours: int) -> DataFrame:
    """Points with enough others within the radius."""
    crowd = within(points, points, radius).where("src_id <> dst_id").groupBy("src_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_neighbours)
    return points if min_neighbours <= 0 else points.join(crowd, points["point_id"] == crowd["src_id"], "left_semi")


def statistical_outliers_removed(points: DataFrame, k: int = 10, deviations: float = 1.0, radius: float | None = None) -> DataFrame:
    """Points whose mean distance to their k nearest others is at most the mean of all plus so many deviations."""
    spread = stored(nearest(points, points, k, radius, own=False).groupBy("src_id").agg(F.avg(F.sqrt("dist_sq")).alias("d")), "spread")
    limit = spread.agg((F.avg("d") + deviations * F.stddev_pop("d")).alias("limit"))
    kept = spread.join(F.broadcast(limit), F.col("d") <= F.col("limit"))  # one row
    return points.join(kept, points["point_id"] == kept["src_id"], "left_semi")


def selected(points: DataFrame, ids: DataFrame) -> DataFrame:
    """extract: the points of an id set."""
    return points.join(ids.select("point_id").distinct(), "point_id", "left_semi")


def rejected(points: DataFrame, ids: DataFrame) -> DataFrame:
    """outliers, noise, erase: the points outside an id set."""
    return points.join(ids.select("point_id").distinct(), "point_id", "left_anti")


def appended(left: DataFrame, right: DataFrame) -> DataFrame:
    """left and right with left's channels: those that right lacks get their defaults, those only right has are dropped."""
    defaults = {"intensity": 0.0, "t": 0.0, "ring": 0, "color": 0, "label": 0, "nx": 0.0, "ny": 0.0, "nz": 0.0}
    missing = [c for c in left.columns if c not in right.columns]
    filled = right.withColumns({c: F.lit(defaults.get(c)).cast(left.schema[c].dataType) for c in missing}) if missing else right
    return left.union(filled.select(left.columns))


def voxel_lookup(points: DataFrame, voxels: DataFrame, size: float) -> DataFrame:
    """Points with the statistics of their own voxel: an equi-join on its three indexes."""
    from .voxel import VOXEL, voxelled

    return voxelled(points, size).join(voxels.select(*VOXEL, *[F.col(c).alias(f"v_{c}") for c in voxels.columns if c not in VOXEL]), list(VOXEL))


def upserted(layers: DataFrame, updates: DataFrame, names: list[str]) -> DataFrame:
    """Map layers with cells updated or added."""
    new = updates.select("row", "col", *[F.col(n).alias(f"__{n}") for n in names])
    return layers.join(new, ["row", "col"], "full_outer").select("row", "col", *[F.coalesce(f"__{n}", n).alias(n) for n in names])
