"""Trajectory text files. TUM: ts tx ty tz qx qy qz qw. KITTI: the 12 numbers of a 3-by-4 matrix, times 0, 1, 2, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TUM = ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
KITTI = ("r00", "r01", "r02", "tx", "r10", "r11", "r12", "ty", "r20", "r21", "r22", "tz")


def _numbers(spark: SparkSession, path: str, count: int) -> DataFrame:
    """Lines with so many numbers, in file order (file; block, line: growing); comments and malformed lines are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parts = lines.where(~F.trim("value").startswith("#")).select("file", "block", "line", F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.try_cast("double")).alias("v"))
    return parts.where((F.size("v") >= count) & ~F.exists(F.slice("v", 1, count), lambda v: v.isNull()))


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    return _numbers(spark, path, 8).select(*[F.col("v")[i].alias(c) for i, c in enumerate(TUM)])


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """A file's poses count from 0 in line order; file says which. A file is one trajectory, and one task's to number."""
    rows = _numbers(spark, path, 12)
    m = {c: F.col("v")[i] for i, c in enumerate(KITTI)}
    trace = m["r00"] + m["r11"] + m["r22"]
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + trace)) / 2
    axis = lambda d, sign: F.sqrt(F.greatest(F.lit(0.0), 1 + d)) / 2 * F.when(sign < 0, -1.0).otherwise(1.0)
    turn = {"qx": axis(m["r00"] - m["r11"] - m["r22"], m["r21"] - m["r12"]), "qy": axis(m["r11"] - m["r00"] - m["r22"], m["r02"] - m["r20"]), "qz": axis(m["r22"] - m["r00"] - m["r11"], m["r10"] - m["r01"]), "qw": w}
    ts = (F.row_number().over(Window.partitionBy("file").orderBy("block", "line")) - 1).cast("double")
    return rows.select("file", ts.alias("ts"), m["tx"].alias("tx"), m["ty"].alias("ty"), m["tz"].alias("tz"), *[v.alias(n) for n, v in turn.items()])


def read_poses(spark: SparkSession, path: str, kind: str = "tum") -> DataFrame:
    """Poses without their times."""
    return {"tum": read_tum, "kitti": read_kitti}[kind](spark, path).drop("ts", "file")


def _written(poses: DataFrame, line: Column, path: str, by: str | None) -> None:
    """A file for each trajectory, in folders named by it; or one file of all poses. A text file is one task's to write."""
    if by is None:
        poses.repartition(1).sortWithinPartitions("ts").select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        poses.repartition(by).sortWithinPartitions(by, "ts").select(line.alias("value"), by).write.mode("overwrite").partitionBy(by).text(path)


def write_tum(poses: DataFrame, path: str, precision: int = 9, by: str | None = None) -> None:
    _written(poses, F.format_string(" ".join([f"%.{precision}f"] * 8), *[F.col(c) for c in TUM]), path, by)


def write_kitti(poses: DataFrame, path: str, precision: int = 9, by: str | None = None) -> None:
    from ..functions.geometry import rotation_of

    r = rotation_of([F.col(c) for c in TUM[4:]])
    cells = [v for i in range(3) for v in (*r[3 * i : 3 * i + 3], F.col(TUM[1 + i]))]
    _written(poses, F.format_string(" ".join([f"%.{precision}f"] * 12), *cells), path, by)
