"""The driver tables seen as point clouds, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.geometry import Grid

GRID = Grid(50.0, 50.0, 0.5)

#: A line's number, for any number of lines: two linear hashes of its keys modulo 2**31 - 1, side by side.
LINE = "((l_orderkey * 8 + l_linenumber) % 2147483647 * {0} + l_partkey % 2147483647 * {1} + l_suppkey % 2147483647 * {2}) % 2147483647"
#: Scans over lineitem: 20 scans; coordinates and channels follow from keys and measures.
POINT = {
    "point_id": f"{LINE.format(48271, 69621, 16807)} * 2147483648 + {LINE.format(39373, 40014, 40692)}",
    "scan_id": "CAST(l_orderkey % 20 AS INT)",
    "x": "l_quantity - 25.5 + CAST((l_partkey * 37) % 100 AS DOUBLE) / 100 - 0.5",
    "y": "CAST((l_suppkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 5000 AS DOUBLE) / 100 - 25",
    "z": "l_tax * 10 + l_discount * 2",
    "intensity": "l_discount",
    "t": "CAST(l_linenumber AS DOUBLE) / 10",
    "ring": "CAST(l_linenumber AS INT)",
    "color": "CAST((l_partkey * 7 + l_suppkey) % 16777216 AS INT)",
}
POINTS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in POINT.items()) + " FROM lineitem"
SEEN_SQL = f"SELECT * FROM ({POINTS_SQL}) WHERE x * x + y * y + z * z BETWEEN 0.25 AND 400 AND z BETWEEN 0.1 AND 0.9"
CELLED_SQL = f"""SELECT *, CAST(floor((25.0 - x) / 0.5) AS BIGINT) AS "row", CAST(floor((25.0 - y) / 0.5) AS BIGINT) AS "col" FROM ({SEEN_SQL})"""
FACTS_SQL = f"""SELECT scan_id, "row", "col", min(z) AS min_z, max(z) AS max_z, count(*) AS n, max(intensity) AS max_intensity, arg_max(color, point_id) AS color FROM ({CELLED_SQL}) WHERE "row" BETWEEN 0 AND 99 AND "col" BETWEEN 0 AND 99 GROUP BY ALL"""
MAP_SQL = f"""SELECT "row", "col", max(z) AS elevation, min(z) AS elevation_min, max(z) AS elevation_max, coalesce(var_samp(z), 0.0) AS variance, count(*) AS n_points, max(intensity) AS intensity, arg_max(color, point_id) AS color FROM ({CELLED_SQL}) WHERE "row" BETWEEN 0 AND 99 AND "col" BETWEEN 0 AND 99 GROUP BY ALL"""
#: Embeddings as a small cloud: the first three components, times ten.
VECTORS_SQL = "SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in POINT.items()])


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan view after range and height filters."""
    from ..operators.filters import point_filter

    return point_filter(points(spark, sf_dir), 0.1, 0.9, 0.5, 20.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.selectExpr("vec_id AS point_id", *[f"CAST(embedding[{k}] AS DOUBLE) * 10 AS {c}" for k, c in enumerate("xyz")])


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one trajectory a user: seconds, a place from the value, a turn about z."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("user_id", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000000 AS ts", "event_id", "value / 10 AS tx", "CAST(event_id % 17 AS DOUBLE) AS ty", "0.0D AS tz", "0.0D AS qx", "0.0D AS qy", "sin(value / 1000) AS qz", "cos(value / 1000) AS qw")
