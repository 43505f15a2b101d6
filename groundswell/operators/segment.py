"""Ground, planes and clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import cell, plane_distance, plane_from_points
from ..plans.tables import stored
from .graph import components
from .spatial import within


BLOCK = 2048  # points that meet all planes of a batch at once


def segment_ground(points: DataFrame, size: float = 0.5, percentile: float = 0.2, thickness: float = 0.3, max_height: float = 0.5, min_points: int = 2) -> DataFrame:
    """points with ground: near the robust minimum of their cell, if that is low and the cell has enough points.

    The minimum is an element of the cell's heights, found from counts of equal heights that run up in order: a cell of
    any number of points takes no array.
    """
    celled = points.withColumns({"gx": cell(F.col("x"), size), "gy": cell(F.col("y"), size)})
    whole = Window.partitionBy("gx", "gy")
    heights = celled.groupBy("gx", "gy", "z").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(whole.orderBy(F.col("z").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = heights.withColumns({"cell_n": F.sum("m").over(whole), "upto": upto}).where(F.col("upto") > F.floor(F.lit(percentile) * (F.col("cell_n") - 1)))
    low = ranked.groupBy("gx", "gy").agg(F.min("z").alias("floor_z"), F.max("cell_n").alias("cell_n"))
    ground = (F.col("cell_n") >= min_points) & (F.col("floor_z") <= max_height) & (F.col("z") <= F.col("floor_z") + thickness)
    return celled.join(low, ["gx", "gy"]).withColumn("ground", ground).select(*points.columns, "ground")


def random_triples(n: int, count: int, seed: int = 42):  # noqa: ANN201
    """Row numbers of three different points each, from a 64-bit shift-register sequence (shifts 13, 7, 17) that no data enters."""
    state, whole = seed or 1, (1 << 64) - 1

    def draw() -> int:
        nonlocal state
        state ^= state << 13 & whole
        state ^= state >> 7
        state ^= state << 17 & whole
        return state % n

    for _ in range(count):
        a = draw()
        while (b := draw()) == a:
            pass
        while (c := draw()) in (a, b):
            pass
        yield a, b, c


def numbered(points: DataFrame) -> DataFrame:
    """points with n_th, from 0, by id: within ranges of ids, then over the ranges."""
    dealt = stored(points.repartitionByRange("point_id").sortWithinPartitions("point_id").withColumn("__part", F.spark_partition_id()), "numbered")
    sums = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    bases = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"))  # a row for each partition
    return dealt.join(F.broadcast(bases), "__part").withColumn("n_th", F.col("__base") + F.row_number().over(Window.partitionBy("__part").orderBy("point_id")) - 1).drop("__part", "__base")


def inlier_counts(lines: DataFrame, planes: list[tuple[float, float, float, float] | None], threshold: float) -> list[int]:
    """How many rows (x, y, z) lie nearer to each plane than the threshold; 0 for none. One pass whose code does not depend on the
    planes, so that nothing is compiled anew for each batch; a partition hands on one row a plane at most."""
    asked = [i for i, p in enumerate(planes) if p]
    nx, ny, nz, d = np.array([planes[i] for i in asked], dtype=np.float64).reshape(-1, 4).T[:, :, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            x, y, z = (np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns)
            for at in range(0, len(x), BLOCK):
                i = slice(at, at + BLOCK)
                n += (np.abs(nx * x[i] + ny * y[i] + nz * z[i] + d) < threshold).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(asked, type=pa.int32()), pa.array(n)], names=["i", "n"])

    counts = [0] * len(planes)
    for r in lines.select("x", "y", "z").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a plane
        counts[r["i"]] = r["n"]
    return counts


def segment_plane(points: DataFrame, threshold: float = 0.1, iterations: int = 1000, probability: float = 0.99, min_inliers: int = 3, refine: bool = True, batch: int = 250) -> tuple[tuple[float, float, float, float] | None, DataFrame, dict]:
    """The plane with most points nearer than the threshold, its points, and n, inliers, fitness, iterations.

    Candidates come from a fixed sequence; a job counts a batch of them in one pass, and the accept-and-shorten rule
    then runs over the counts in order, so the outcome is that of trying one at a time.
    """
    lines = stored(numbered(points.select("point_id", "x", "y", "z")), "points")
    n = lines.count()
    none = (None, points.limit(0), {"n": n, "inliers": 0, "fitness": 0.0, "iterations": 0})
    if n < 3:
        return none
    triples = list(random_triples(n, iterations))
    best, most, limit, done = None, 0, iterations, 0
    while done < limit:
        some = triples[done : min(limit, done + batch)]
        wanted = sorted({i for t in some for i in t})
        at = {r["n_th"]: np.array([r["x"], r["y"], r["z"]]) for r in lines.where(F.col("n_th").isin(wanted)).collect()}  # three a candidate
        planes = [plane_from_points(*(at[i] for i in t)) for t in some]
        counts = inlier_counts(lines, planes, threshold)
        for i, p in enumerate(planes):
            if done >= limit:
                break
            done += 1
            if p and counts[i] > most:
                best, most = p, counts[i]
                w = most / n
                if 0 < w < 1 and math.log(1 - w**3) < 0:
                    limit = min(limit, math.ceil(math.log(1 - probability) / math.log(1 - w**3)))
    if best is None or most < min_inliers:
        return none
    near = lambda p: F.abs(plane_distance(*map(F.lit, p))) < threshold
    if refine:
        m = lines.where(near(best)).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]).first()
        _, axes = np.linalg.eigh(np.array([[m["cxx"], m["cxy"], m["cxz"]], [m["cxy"], m["cyy"], m["cyz"]], [m["cxz"], m["cyz"], m["czz"]]]))
        normal = axes[:, 0]
        best = (*map(float, normal), float(-normal @ [m["mx"], m["my"], m["mz"]]))
        most = lines.where(near(best)).count()
    return best, points.where(near(best)), {"n": n, "inliers": most, "fitness": most / n, "iterations": done}


def segment_planes(points: DataFrame, most: int = 5, min_fitness: float = 0.1, **options: object) -> list[tuple[tuple[float, float, float, float], DataFrame, dict]]:
    """Planes one after another, each among the points that no plane before has taken."""
    found, left = [], points
    for _ in range(most):
        plane, inliers, stats = segment_plane(left, **options)
        if plane is None or stats["fitness"] < min_fitness:
            break
        inliers = stored(inliers, "plane")
        found.append((plane, inliers, stats))
        left = stored(left.join(inliers.select("point_id"), "point_id", "left_anti"), "rest")
    return found


def euclidean_clusters(points: DataFrame, tolerance: float = 0.5, min_size: int = 10, max_size: int = 100_000) -> DataFrame:
    """cluster_id (from 0, largest first, then smallest id), point_id: components of points no farther apart than the tolerance."""
    pairs = within(points, points, tolerance).where("src_id < dst_id").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    linked = components(pairs)
    every = points.select("point_id").join(linked, F.col("point_id") == F.col("node"), "left").select("point_id", F.coalesce("component", "point_id").alias("root"))
    sizes = every.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(min_size, max_size))
    ranked = sizes.withColumn("cluster_id", (F.row_number().over(Window.orderBy(F.desc("n"), "root")) - 1).cast("int"))  # a row for each cluster
    return every.join(ranked, "root").select("cluster_id", "point_id")


def cluster_labels(points: DataFrame, clusters: DataFrame, semantic: int) -> DataFrame:
    """points with label: the semantic class above 16 bits of the cluster's number, from 1; 0 below for noise."""
    met = points.drop("label").join(clusters, "point_id", "left")
    return met.withColumn("label", (F.lit(semantic << 16) + F.coalesce(F.col("cluster_id") + 1, F.lit(0))).cast("long")).drop("cluster_id")


def cluster_boxes(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each cluster's size, bounding box and centroid."""
    bounds = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in "xyz"]
    return points.join(clusters, "point_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *bounds)
