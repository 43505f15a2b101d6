"""Clouds made up on the executors from a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F


def _base(spark: SparkSession, n: int, extent: float, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("point_id"), ((F.rand(seed) - 0.5) * 2 * extent).alias("x"), ((F.rand(seed + 1) - 0.5) * 2 * extent).alias("y"), F.randn(seed + 2).alias("noise"))


def sine_terrain(spark: SparkSession, n: int = 10_000, extent: float = 10.0, noise: float = 0.02, seed: int = 42) -> DataFrame:
    height = 0.5 * F.sin(F.col("x") * math.pi / 5) * F.cos(F.col("y") * math.pi / 5)
    return _base(spark, n, extent, seed).withColumn("z", height + noise * F.col("noise")).drop("noise")


def boxes(spark: SparkSession, n: int = 10_000, extent: float = 10.0, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """Level ground with two boxes on it."""
    in_ = lambda cx, cy, half: (F.abs(F.col("x") - cx) <= half) & (F.abs(F.col("y") - cy) <= half)
    top = F.when(in_(3.0, 2.0, 1.0), 1.0).when(in_(-2.0, -3.0, 1.5), 0.6).otherwise(0.0)
    return _base(spark, n, extent, seed).withColumn("z", top + noise * F.col("noise")).drop("noise")


def ramp(spark: SparkSession, n: int = 10_000, extent: float = 10.0, slope: float = 0.2, noise: float = 0.01, seed: int = 42) -> DataFrame:
    return _base(spark, n, extent, seed).withColumn("z", slope * F.col("x") + noise * F.col("noise")).drop("noise")
