"""python -m groundswell in.pcd out.pcd [resolution]: a terrain model of a cloud, as a cloud."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession, functions as F

from .operators.dem import DemConfig, build_dem
from .operators.raster import to_points
from .sources.clouds import encoded, read_pcd, write_files


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("pcd2dem").getOrCreate()
    cells, grid = build_dem(read_pcd(spark, args[0]).select("point_id", "x", "y", "z"), DemConfig(resolution=float(args[2]) if len(args) == 3 else 0.1))
    folder, _, name = args[1].rpartition("/")
    made = encoded(to_points(cells, grid).select("point_id", "x", "y", "z", F.lit(0).alias("scan_id")))  # one file, which a task builds
    write_files(made.withColumn("path", F.lit(name)), folder)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
