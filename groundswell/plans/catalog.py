"""Every registered query with, where SQL can say it, its DuckDB twin. Doubles are rounded alike on both sides."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import Grid, Rigid, robust_weight, rpy, transformed, voxel, voxel_key
from ..functions.sensors import Constant, Lidar, Rgbd, with_covariance
from ..functions.geometry import rotated_covariance
from ..operators import asof, dem, estimate, filters, normals, raster, raycast, register, segment, spatial, stencil
from ..operators import voxel as vox
from ..sources import clouds, maps, messages, trajectories
from ..sources.pieces import PIECE
from . import views
from .config import Mapping, PointFilter, Postprocess
from .mapper import Mapper, postprocessed
from .tables import shared_dir
from .views import CELLED_SQL, FACTS_SQL, GRID, MAP_SQL, POINTS_SQL, SEEN_SQL, VECTORS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = settled(sql)
        return f

    return put


def off_ties(digits: int) -> float:
    """Added before rounding: short decimals then lie off the rounding ties, where the order of a sum would decide."""
    return 3.7 * 10.0 ** -(digits + 2)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + off_ties(digits), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def settled(sql: str) -> str:
    """SQL whose round(value, digits) calls add the same."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner, tail = sql[i + 6 : j - 1], sql[j - 4 : j - 1]
        out += sql[at:i]
        if tail[:2] == ", " and tail[2].isdigit():
            out += f"round(({inner[:-3]}) + {off_ties(int(tail[2]))!r}, {tail[2]})"
        else:
            out += sql[i:j]
        at = j
    return out + sql[at:]


XYZ_SQL = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z"


def ids(df: DataFrame) -> DataFrame:
    return rounded(df.select("point_id", "x", "y", "z"))


# --- filters --------------------------------------------------------------------------------------------------------

BOX = ((-10.0, -10.0, 0.0), (10.0, 10.0, 0.5))
BOX_SQL = "x BETWEEN -10 AND 10 AND y BETWEEN -10 AND 10 AND z BETWEEN 0 AND 0.5"
RANGE_SQL = "x * x + y * y + z * z BETWEEN 4.0 AND 225.0"
LOW, HIGH = math.radians(20), math.radians(75)
ANGLE_SQL = f"({math.cos(LOW)!r} * y - {math.sin(LOW)!r} * x >= -1e-5 AND {math.sin(HIGH)!r} * x - {math.cos(HIGH)!r} * y >= -1e-5)"
for outside in (False, True):
    side, no = ("outside", "NOT ") if outside else ("inside", "")
    head = f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL}) WHERE {no}"
    query(f"crop_box_{side}", f"{head}({BOX_SQL})")(lambda s, d, o=outside: ids(filters.crop_box(views.points(s, d), *BOX, outside=o)))
    query(f"crop_range_{side}", f"{head}({RANGE_SQL})")(lambda s, d, o=outside: ids(filters.crop_range(views.points(s, d), 2.0, 15.0, outside=o)))
    query(f"crop_angle_{side}", f"{head}{ANGLE_SQL}")(lambda s, d, o=outside: ids(filters.crop_angle(views.points(s, d), LOW, HIGH, outside=o)))
    for axis, lo, hi in (("x", -5.0, 5.0), ("y", 0.0, 12.0), ("z", 0.2, 0.6)):
        query(f"crop_{axis}_{side}", f"{head}({axis} BETWEEN {lo} AND {hi})")(lambda s, d, o=outside, a=axis, lo=lo, hi=hi: ids(filters.crop_axis(views.points(s, d), a, lo, hi, outside=o)))


@query("crop_angle_wrapped", f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL}) WHERE ({math.cos(2.5)!r} * y - {math.sin(2.5)!r} * x >= -1e-5 OR {math.sin(1.0)!r} * x - {math.cos(1.0)!r} * y >= -1e-5)")
def crop_angle_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(filters.crop_angle(views.points(spark, sf_dir), 2.5, 1.0))


@query("remove_invalid", f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL}) WHERE point_id % 10 <> 0")
def remove_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth point is spoilt with NaN first."""
    spoilt = views.points(spark, sf_dir).withColumn("z", F.when(F.col("point_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    return ids(filters.remove_invalid(spoilt))


@query("predicate_filter", f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL}) WHERE intensity > 0.05 AND ring % 2 = 1")
def predicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(filters.where(views.points(spark, sf_dir), (F.col("intensity") > 0.05) & (F.col("ring") % 2 == 1)))


@query("point_filter", f"SELECT point_id, {XYZ_SQL} FROM ({SEEN_SQL})")
def point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(views.seen(spark, sf_dir))


# --- projections ----------------------------------------------------------------------------------------------------

POSE = Rigid.from_rpy(0.1, -0.2, 0.7, (1.0, 2.0, 0.5))


def _moved_sql(r: tuple[float, ...], t: tuple[float, ...]) -> str:
    return ", ".join(f"round({r[3 * i]!r} * x + {r[3 * i + 1]!r} * y + {r[3 * i + 2]!r} * z + {t[i]!r}, 6) AS {c}" for i, c in enumerate("xyz"))


@query("transform_cloud", f"SELECT point_id, {_moved_sql(POSE.r, POSE.t)}, 'map' AS frame_id FROM ({POINTS_SQL})")
def transform_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transformed(views.points(spark, sf_dir).select("point_id", "x", "y", "z"), POSE, "map"))


@query("rpy_angles", f"SELECT point_id, round(atan2(sin(z), cos(z)), 6) AS roll, round(asin(sin(y / 30)), 6) AS pitch, round(atan2(sin(x / 10), cos(x / 10)), 6) AS yaw FROM ({POINTS_SQL})")
def rpy_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles taken back out of a rotation made of them."""
    a, b, c = F.col("z"), F.col("y") / 30, F.col("x") / 10
    r = [
        F.cos(c) * F.cos(b), F.cos(c) * F.sin(b) * F.sin(a) - F.sin(c) * F.cos(a), F.cos(c) * F.sin(b) * F.cos(a) + F.sin(c) * F.sin(a),
        F.sin(c) * F.cos(b), F.sin(c) * F.sin(b) * F.sin(a) + F.cos(c) * F.cos(a), F.sin(c) * F.sin(b) * F.cos(a) - F.cos(c) * F.sin(a),
        -F.sin(b), F.cos(b) * F.sin(a), F.cos(b) * F.cos(a),
    ]
    return rounded(views.points(spark, sf_dir).select("point_id", *[v.alias(n) for n, v in zip(("roll", "pitch", "yaw"), rpy(r), strict=True)]))


VOX_SQL = ", ".join(f"CAST(floor({c} * (1.0 / 0.5)) AS BIGINT) AS v{c}" for c in "xyz")


@query("voxel_key", f"SELECT point_id, vx, vy, vz, ((vz + 1048576) << 42) | ((vy + 1048576) << 21) | (vx + 1048576) AS key FROM (SELECT point_id, {VOX_SQL} FROM ({POINTS_SQL}))")
def voxel_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.points(spark, sf_dir).select("point_id", *[voxel(F.col(c), 0.5).alias(f"v{c}") for c in "xyz"])
    return v.withColumn("key", voxel_key(F.col("vx"), F.col("vy"), F.col("vz")))


@query("robust_weights", f"SELECT point_id, round(CASE WHEN abs(x) <= 1.345 THEN 1 ELSE 1.345 / abs(x) END, 6) AS huber, round(CASE WHEN abs(x) <= 4.685 THEN power(1 - (x / 4.685) * (x / 4.685), 2) ELSE 0 END, 6) AS tukey, round(1 / (1 + (x / 2.385) * (x / 2.385)), 6) AS cauchy FROM ({POINTS_SQL})")
def robust_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.points(spark, sf_dir).select("point_id", *[robust_weight(F.col("x"), k).alias(k) for k in ("huber", "tukey", "cauchy")]))


R = POSE.r
UP_SQL = f"{R[6]!r} * {R[6]!r} * cxx + {R[7]!r} * {R[7]!r} * cyy + {R[8]!r} * {R[8]!r} * czz + 2 * ({R[6]!r} * {R[7]!r} * cxy + {R[6]!r} * {R[8]!r} * cxz + {R[7]!r} * {R[8]!r} * cyz)"


def _sensor_sql(cov: str) -> str:
    return f"SELECT point_id, round({UP_SQL}, 6) AS czz FROM (SELECT point_id, {cov} FROM (SELECT *, x * x + y * y + z * z AS r2 FROM ({POINTS_SQL})))"


def _lidar(i: str, j: str) -> str:
    return f"CASE WHEN r2 < 1e-6 THEN {0.01 if i == j else 0.0} ELSE (4e-4 - greatest(r2 * 1e-6, 1e-6)) * ({i} * {j} / r2)" + (" + greatest(r2 * 1e-6, 1e-6)" if i == j else "") + f" END AS c{i}{j}"


SENSORS = {
    "constant": (Constant(0.1), "0.01 AS cxx, 0.0 AS cxy, 0.0 AS cxz, 0.01 AS cyy, 0.0 AS cyz, 0.01 AS czz"),
    "lidar": (Lidar(), ", ".join(_lidar(*p) for p in ("xx", "xy", "xz", "yy", "yz", "zz"))),
    "rgbd": (Rgbd(), "CASE WHEN z <= 0 THEN 0.01 ELSE 1e-6 * z * z END AS cxx, 0.0 AS cxy, 0.0 AS cxz, CASE WHEN z <= 0 THEN 0.01 ELSE 1e-6 * z * z END AS cyy, 0.0 AS cyz, CASE WHEN z <= 0 THEN 0.01 ELSE power(0.001 + 0.002 * (z - 0.4) * (z - 0.4), 2) END AS czz"),
}
for kind, (model, cov) in SENSORS.items():
    query(f"sensor_{kind}", _sensor_sql(cov))(lambda s, d, m=model: rounded(rotated_covariance(with_covariance(views.points(s, d), m), POSE).select("point_id", "czz")))


# --- voxels and rasters ---------------------------------------------------------------------------------------------

VOXELLED_SQL = f"SELECT *, {VOX_SQL} FROM ({POINTS_SQL})"
MEANS_SQL = "round(avg(intensity), 6) AS intensity, round(avg(t), 6) AS t"


@query("voxel_centroid", f"SELECT vx, vy, vz, min(point_id) AS point_id, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, {MEANS_SQL}, (CAST(floor(avg((color >> 16) & 255)) AS INT) << 16) + (CAST(floor(avg((color >> 8) & 255)) AS INT) << 8) + CAST(floor(avg(color & 255)) AS INT) AS color, arg_min(scan_id, point_id) AS scan_id, arg_min(ring, point_id) AS ring FROM ({VOXELLED_SQL}) GROUP BY vx, vy, vz")
def voxel_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.voxel_grid(views.points(spark, sf_dir), 0.5))


@query("voxel_center", f"SELECT vx, vy, vz, min(point_id) AS point_id, count(*) AS n, CAST((vx + 0.5) * 0.5 AS DOUBLE) AS x, CAST((vy + 0.5) * 0.5 AS DOUBLE) AS y, CAST((vz + 0.5) * 0.5 AS DOUBLE) AS z, {MEANS_SQL} FROM ({VOXELLED_SQL}) GROUP BY vx, vy, vz")
def voxel_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.voxel_grid(views.points(spark, sf_dir).select("point_id", "x", "y", "z", "intensity", "t"), 0.5, "center"))


@query("voxel_any", f"SELECT vx, vy, vz, min(point_id) AS point_id FROM ({VOXELLED_SQL}) GROUP BY vx, vy, vz")
def voxel_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.voxel_grid(views.points(spark, sf_dir).select("point_id", "x", "y", "z"), 0.5, "any").select("vx", "vy", "vz", "point_id")


@query("voxel_nearest", f"SELECT vx, vy, vz, point_id FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY 0.0 + (x - (vx + 0.5) * 0.5) * (x - (vx + 0.5) * 0.5) + (y - (vy + 0.5) * 0.5) * (y - (vy + 0.5) * 0.5) + (z - (vz + 0.5) * 0.5) * (z - (vz + 0.5) * 0.5), point_id) AS k FROM ({VOXELLED_SQL})) WHERE k = 1")
def voxel_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.voxel_grid(views.points(spark, sf_dir).select("point_id", "x", "y", "z"), 0.5, "nearest").select("vx", "vy", "vz", "point_id")


@query("grid_max_z", f"SELECT cx, cy, point_id, round(z, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY z DESC, point_id) AS k FROM (SELECT *, CAST(floor(x * (1.0 / 0.5)) AS BIGINT) AS cx, CAST(floor(y * (1.0 / 0.5)) AS BIGINT) AS cy FROM ({POINTS_SQL}))) WHERE k = 1")
def grid_max_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.grid_max_z(views.points(spark, sf_dir), 0.5).select("cx", "cy", "point_id", "z"))


MOMENTS_SQL = "count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, " + ", ".join(f"round(CASE WHEN count(*) < 3 THEN {0.001 if p[0] == p[1] else 0.0} ELSE covar_pop({p[0]}, {p[1]}) END, 6) + 0.0 AS c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query("voxel_distribution", f"SELECT vx, vy, vz, {MOMENTS_SQL} FROM (SELECT *, {', '.join(f'CAST(floor({c} * (1.0 / 2.0)) AS BIGINT) AS v{c}' for c in 'xyz')} FROM ({POINTS_SQL})) GROUP BY vx, vy, vz")
def voxel_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(vox.voxel_distributions(views.points(spark, sf_dir), 2.0))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")})  # no negative zero


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterized(views.seen(spark, sf_dir), GRID)


def terrain(spark: SparkSession, sf_dir: str, method: str = "max") -> DataFrame:
    return raster.from_points(views.seen(spark, sf_dir), GRID, method)


FACT_COLUMNS = 'scan_id, "row", "col", round(min_z, 6) AS min_z, round(max_z, 6) AS max_z, n, max_intensity, color'


@query("rasterize_scan", f"SELECT {FACT_COLUMNS} FROM ({FACTS_SQL})")
def rasterize_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facts(spark, sf_dir))


LAYERS_SQL = '"row", "col", round(elevation, 6) AS elevation, round(elevation_min, 6) AS elevation_min, round(elevation_max, 6) AS elevation_max, round(variance, 6) AS variance, n_points, intensity, color'
for method, sql in (("max", MAP_SQL), ("min", MAP_SQL.replace("max(z) AS elevation,", "min(z) AS elevation,")), ("mean", MAP_SQL.replace("max(z) AS elevation,", "avg(z) AS elevation,"))):
    query(f"raster_{method}", f"SELECT {LAYERS_SQL} FROM ({sql})")(lambda s, d, m=method: rounded(terrain(s, d, m)))


@query("raster_autosize", f"""WITH p AS ({POINTS_SQL}), b AS (SELECT max(x) - min(x) + 1.0 AS lx, max(y) - min(y) + 1.0 AS ly, (max(x) + min(x)) / 2 AS cx, (max(y) + min(y)) / 2 AS cy FROM p)
SELECT CAST(floor((cx + round(lx / 0.5) * 0.5 / 2 - x) / 0.5) AS BIGINT) AS "row", CAST(floor((cy + round(ly / 0.5) * 0.5 / 2 - y) / 0.5) AS BIGINT) AS "col", count(*) AS n_points, round(max(z), 6) AS elevation FROM p, b GROUP BY ALL""")
def raster_autosize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir)
    return rounded(raster.from_points(p, raster.fitted_grid(p, 0.5)).select("row", "col", "n_points", "elevation"))


@query("running_min_max", f'SELECT "row", "col", round(min(min_z), 6) AS elevation_min, round(max(max_z), 6) AS elevation_max FROM ({FACTS_SQL}) GROUP BY ALL')
def running_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.running_bounds(facts(spark, sf_dir)))


@query("obstacle_last", f'WITH f AS ({FACTS_SQL}) SELECT "row", "col", round(CASE WHEN max_z > min_z THEN max_z END, 6) AS obstacle FROM f WHERE scan_id = (SELECT max(scan_id) FROM f)')
def obstacle_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.obstacle(facts(spark, sf_dir)))


@query("intensity_color", f'SELECT "row", "col", max(max_intensity) AS intensity, arg_max(color, scan_id) AS color FROM ({FACTS_SQL}) GROUP BY ALL')
def intensity_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.latest_layers(facts(spark, sf_dir))


@query("map_to_points", f'SELECT "row" * 100 + "col" AS point_id, CAST(24.75 - "row" * 0.5 AS DOUBLE) AS x, CAST(24.75 - "col" * 0.5 AS DOUBLE) AS y, round(elevation, 6) AS z, intensity, color FROM ({MAP_SQL})')
def map_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.to_points(terrain(spark, sf_dir), GRID))


@query("map_stats", f"SELECT round(count(elevation) * 100.0 / 10000, 6) AS coverage, round(min(elevation), 6) AS min_z, round(avg(elevation), 6) AS mean_z, round(max(elevation), 6) AS max_z FROM ({MAP_SQL})")
def map_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.map_stats(terrain(spark, sf_dir), GRID))


@query("png_colors", f"""WITH m AS ({MAP_SQL}), s AS (SELECT list_sort(list(elevation)) AS a, count(*) AS n FROM m), e AS (SELECT a[1 + CAST(floor(n * 0.01) AS INT)] AS lo, a[1 + least(CAST(floor(n * 0.99) AS INT), n - 1)] AS hi FROM s)
SELECT "row", "col", CAST(floor(greatest(0.0, least(1.0, (elevation - lo) / CASE WHEN hi - lo >= 1e-6 THEN hi - lo ELSE 1 END)) * 255 + 0.5) AS INT) AS r, 255 AS a FROM m, e""")
def png_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.shaded(terrain(spark, sf_dir), "elevation", colormap="grayscale").select("row", "col", "r", "a")


# --- estimators -----------------------------------------------------------------------------------------------------

KALMAN_SQL = """list_reduce(list_transform(list_sort(l), lambda e: {'z': e.z, 'r': 0.0009, 'x': e.z, 'p': 0.0009, 'n': 1, 'mean': e.z, 'm2': 0.0}),
 lambda a, e: {'z': e.z, 'r': e.r, 'x': a.x + a.p / (a.p + e.r) * (e.z - a.x), 'p': least(greatest((1 - a.p / (a.p + e.r)) * a.p, 1e-4), 1e-2), 'n': a.n + 1, 'mean': a.mean + (e.z - a.mean) / (a.n + 1), 'm2': a.m2 + (e.z - a.mean) * (e.z - (a.mean + (e.z - a.mean) / (a.n + 1)))})"""


def _kalman_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, round(s.x, 6) AS elevation, CAST(s.n AS BIGINT) AS n_points, round(CASE WHEN s.n > 1 THEN s.m2 / (s.n - 1) ELSE 0 END, 6) AS variance,
 round(s.x - 2 * sqrt(greatest(CASE WHEN s.n > 1 THEN s.m2 / (s.n - 1) ELSE 0 END, 0)), 6) AS lower_bound, round(s.x + 2 * sqrt(greatest(CASE WHEN s.n > 1 THEN s.m2 / (s.n - 1) ELSE 0 END, 0)), 6) AS upper_bound
 FROM (SELECT {keys}, {KALMAN_SQL} AS s FROM ({source}))"""


def kalman_layers(cells: DataFrame) -> DataFrame:
    return estimate.layers(estimate.fold(cells)).drop("ghost_removal")


KALMAN_MAP_SQL = _kalman_sql(f"""SELECT "row", "col", list({{'scan_id': scan_id, 'z': min_z}}) AS l FROM ({FACTS_SQL}) GROUP BY ALL""", '"row", "col"')


@query("kalman_fold", KALMAN_MAP_SQL)
def kalman_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = facts(spark, sf_dir).select("scan_id", "row", "col", F.col("min_z").alias("z"), F.lit(0.0009).alias("variance"))
    return rounded(kalman_layers(cells))


@query("kalman_fold_events", _kalman_sql("""SELECT user_id, list({'ts': ts, 'id': event_id, 'z': value}) AS l FROM events GROUP BY ALL""", "user_id"))
def kalman_fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one cell's measurements."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = e.select(F.col("user_id").alias("row"), F.lit(0).cast("long").alias("col"), F.struct("ts", "event_id").alias("scan_id"), F.col("value").alias("z"), F.lit(0.0009).alias("variance"))
    return rounded(kalman_layers(cells).drop("col").withColumnRenamed("row", "user_id"))


@query("p2_fold")
def p2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(estimate.p2_fold(e, order=("ts", "event_id"), by=("user_id",), value="value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kalman_fold(spark, sf_dir)


# --- stencils -------------------------------------------------------------------------------------------------------

OFFSETS_SQL = "(SELECT i AS di, j AS dj FROM range(-1, 2) a(i), range(-1, 2) b(j))"


def _inpaint_sql(passes: int) -> str:
    steps = [f'm0 AS (SELECT "row", "col", elevation AS v FROM ({MAP_SQL}))']
    for k in range(passes):
        steps.append(f"""m{k + 1} AS (SELECT "row", "col", coalesce(own, CASE WHEN n >= 2 THEN s / n END) AS v FROM (
 SELECT m."row" - di AS "row", m."col" - dj AS "col", max(CASE WHEN di = 0 AND dj = 0 THEN v END) AS own, sum(CASE WHEN di <> 0 OR dj <> 0 THEN v END) AS s, count(CASE WHEN di <> 0 OR dj <> 0 THEN 1 END) AS n
 FROM m{k} m, {OFFSETS_SQL} GROUP BY ALL) WHERE "row" BETWEEN 0 AND 99 AND "col" BETWEEN 0 AND 99 AND coalesce(own, CASE WHEN n >= 2 THEN s / n END) IS NOT NULL)""")
    return f"WITH {', '.join(steps)} SELECT \"row\", \"col\", round(v, 6) AS elevation FROM m{passes}"


for passes in (1, 3):
    query(f"inpaint_{passes}", _inpaint_sql(passes))(lambda s, d, p=passes: rounded(stencil.inpainted(terrain(s, d), GRID, p)))


@query("smooth_median", f"""WITH m AS (SELECT "row", "col", elevation AS v FROM ({MAP_SQL})), g AS (SELECT a."row", a."col", any_value(a.v) AS own, list_sort(list(b.v)) AS vs FROM m a JOIN m b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b."col" BETWEEN a."col" - 1 AND a."col" + 1 GROUP BY ALL)
SELECT "row", "col", round(CASE WHEN len(vs) >= 5 THEN vs[1 + len(vs) // 2] ELSE own END, 6) AS elevation FROM (SELECT "row", "col", own, vs FROM g)""".replace("any_value(a.v)", "max(a.v)"))
def smooth_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.smoothed(terrain(spark, sf_dir)))


BOUNDED_SQL = f'SELECT "row", "col", elevation_min AS lo, elevation_max AS hi FROM ({MAP_SQL})'


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).select("row", "col", F.col("elevation_min").alias("lower_bound"), F.col("elevation_max").alias("upper_bound"))


@query("uncertainty_fusion", f"""WITH m AS ({BOUNDED_SQL}), p AS (
 SELECT a."row", a."col", a.lo AS lo0, a.hi AS hi0, b.lo, b.hi, exp(-(power(a."row" - b."row", 2) + power(a."col" - b."col", 2)) * 0.25 / (2 * 0.5 * 0.5)) / (b.hi - b.lo + 1e-4) AS w
 FROM m a JOIN m b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b."col" BETWEEN a."col" - 2 AND a."col" + 2 AND (power(a."row" - b."row", 2) + power(a."col" - b."col", 2)) * 0.25 <= 1.0
), c AS (SELECT *, count(*) OVER g AS n, sum(CASE WHEN w > 1e-6 THEN w END) OVER g AS tot, sum(CASE WHEN w > 1e-6 THEN w END) OVER (g ORDER BY lo, w ROWS UNBOUNDED PRECEDING) AS cl, sum(CASE WHEN w > 1e-6 THEN w END) OVER (g ORDER BY hi, w ROWS UNBOUNDED PRECEDING) AS ch FROM p WINDOW g AS (PARTITION BY "row", "col"))
SELECT "row", "col", round(CASE WHEN max(n) >= 3 THEN min(CASE WHEN cl >= 0.01 * tot THEN lo END) ELSE max(lo0) END, 6) AS lower_bound, round(CASE WHEN max(n) >= 3 THEN min(CASE WHEN ch >= 0.99 * tot THEN hi END) ELSE max(hi0) END, 6) AS upper_bound FROM c GROUP BY "row", "col" """)
def uncertainty_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.fused_uncertainty(bounded(spark, sf_dir), 0.5, radius=1.0, sigma=0.5))


@query("uncertainty_range", f'SELECT "row", "col", round(hi - lo, 6) AS uncertainty_range FROM ({BOUNDED_SQL})')
def uncertainty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.uncertainty_range(bounded(spark, sf_dir)))


@query("terrain_moments", f"""WITH m AS (SELECT "row", "col", elevation AS v FROM ({MAP_SQL})), g AS (SELECT a."row", a."col", count(*) AS n, list_sort(list(b.v)) AS zs, covar_pop((a."row" - b."row") * 0.5, b.v) AS cxz, var_pop(b.v) AS czz FROM m a JOIN m b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b."col" BETWEEN a."col" - 2 AND a."col" + 2 AND power(a."row" - b."row", 2) + power(a."col" - b."col", 2) <= 4 GROUP BY a."row", a."col")
SELECT "row", "col", n, round(zs[1 + CAST(floor(0.95 * (n - 1)) AS INT)] - zs[1 + CAST(floor(0.05 * (n - 1)) AS INT)], 6) AS step, round(cxz, 6) + 0.0 AS cxz, round(czz, 6) AS czz FROM g WHERE n >= 4""")
def terrain_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(stencil.neighbourhood_moments(terrain(spark, sf_dir), 0.5, radius=1.0).select("row", "col", "n", "step", "cxz", "czz"))
    return out.withColumn("cxz", F.col("cxz") + 0.0)


def upright(df: DataFrame, digits: int) -> DataFrame:
    """Features rounded; the sign of a normal that lies flat is open, so its parts are taken as they are without it."""
    flat = F.abs(F.col("nz")) <= 1e-6
    return rounded(df.withColumns({c: F.when(flat, F.abs(F.col(c))).otherwise(F.col(c)) for c in ("nx", "ny", "nz")}), digits)


@query("terrain_features")
def terrain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upright(stencil.terrain_features(terrain(spark, sf_dir), 0.5, radius=1.0), 4)


# --- neighbours -----------------------------------------------------------------------------------------------------

PAIRS_SQL = f"WITH v AS ({VECTORS_SQL}), p AS (SELECT a.point_id AS src_id, b.point_id AS dst_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS dist_sq FROM v a, v b)"


@query("radius_neighbors", f"{PAIRS_SQL} SELECT src_id, dst_id, round(dist_sq, 6) AS dist_sq FROM p WHERE dist_sq <= 0.25")
def radius_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir)
    return rounded(spatial.within(v, v, 0.5))


@query("radius_outlier", f"{PAIRS_SQL} SELECT point_id, {XYZ_SQL} FROM v WHERE point_id IN (SELECT src_id FROM p WHERE dist_sq <= 0.25 AND src_id <> dst_id GROUP BY src_id HAVING count(*) >= 3)")
def radius_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spatial.radius_outliers_removed(views.vectors(spark, sf_dir), 0.5, 3))


@query("knn", f"{PAIRS_SQL} SELECT src_id, CAST(k AS INT) AS rank, dst_id, round(dist_sq, 6) AS dist_sq FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY dist_sq, dst_id) AS k FROM p) WHERE k <= 5")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir)
    return rounded(spatial.nearest(v, v, 5, 0.5))


SPREAD_SQL = f"{PAIRS_SQL}, s AS (SELECT src_id, avg(sqrt(dist_sq)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY dist_sq, dst_id) AS k FROM p WHERE src_id <> dst_id) WHERE k <= 10 GROUP BY src_id)"


@query("statistical_outlier", f"{SPREAD_SQL} SELECT point_id, {XYZ_SQL} FROM v WHERE point_id IN (SELECT src_id FROM s WHERE d <= (SELECT avg(d) + stddev_pop(d) FROM s))")
def statistical_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spatial.statistical_outliers_removed(views.vectors(spark, sf_dir)))


@query("index_complement", f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM ({SEEN_SQL}) s WHERE s.point_id = p.point_id)")
def index_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spatial.rejected(views.points(spark, sf_dir), views.seen(spark, sf_dir)))


@query("index_selection", f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL}) p WHERE EXISTS (SELECT 1 FROM ({SEEN_SQL}) s WHERE s.point_id = p.point_id)")
def index_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(spatial.selected(views.points(spark, sf_dir), views.seen(spark, sf_dir)))


@query("append_clouds", f"SELECT point_id, {XYZ_SQL}, intensity FROM ({POINTS_SQL}) UNION ALL SELECT point_id, {XYZ_SQL}, 0.0 AS intensity FROM ({VECTORS_SQL})")
def append_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.appended(views.points(spark, sf_dir).select("point_id", "x", "y", "z", "intensity"), views.vectors(spark, sf_dir)))


@query("floating_point_removal", f"""WITH c AS (SELECT * FROM ({CELLED_SQL}) WHERE "row" BETWEEN 0 AND 99 AND "col" BETWEEN 0 AND 99), l AS (SELECT *, min(z) OVER (PARTITION BY "row", "col") AS low FROM c), b AS (SELECT *, CAST(floor((z - low) / 0.1) AS BIGINT) AS bin FROM l), g AS (SELECT "row", "col", low + (bin + 0.5) * 0.1 AS ground FROM (SELECT "row", "col", low, bin, row_number() OVER (PARTITION BY "row", "col" ORDER BY count(*) DESC, bin) AS k FROM b GROUP BY "row", "col", low, bin) WHERE k = 1)
SELECT point_id, {XYZ_SQL} FROM c JOIN g USING ("row", "col") WHERE z <= ground + 0.2""")
def floating_point_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids(dem.floating_points_removed(views.seen(spark, sf_dir), GRID, 0.2, 0.1))


@query("build_dem")
def build_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dem.build_dem(views.vectors(spark, sf_dir), dem.DemConfig(resolution=0.25))[0])


@query("normals_knn")
def normals_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normals.with_normals(views.vectors(spark, sf_dir), 10, viewpoint=(0.0, 0.0, 10.0)), 5)


@query("covariances_gicp")
def covariances_gicp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normals.with_normals(views.vectors(spark, sf_dir), 10, covariances=True), 5)


# --- segmentation ---------------------------------------------------------------------------------------------------


@query("segment_ground", f"""WITH c AS (SELECT point_id, z, CAST(floor(x * (1.0 / 0.5)) AS BIGINT) AS gx, CAST(floor(y * (1.0 / 0.5)) AS BIGINT) AS gy FROM ({POINTS_SQL})), l AS (SELECT gx, gy, count(*) AS n, list_sort(list(z)) AS zs FROM c GROUP BY gx, gy)
SELECT point_id, n >= 2 AND zs[1 + CAST(floor(0.2 * (n - 1)) AS INT)] <= 0.5 AND z <= zs[1 + CAST(floor(0.2 * (n - 1)) AS INT)] + 0.3 AS ground FROM c JOIN l USING (gx, gy)""")
def segment_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_ground(views.points(spark, sf_dir)).select("point_id", "ground")


def facing_up(plane: tuple[float, float, float, float]) -> tuple[float, ...]:
    return tuple(-v for v in plane) if plane[2] < 0 else plane


@query("ransac_plane")
def ransac_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane, _, stats = segment.segment_plane(views.vectors(spark, sf_dir), threshold=0.3)
    row = (*facing_up(plane or (0.0, 0.0, 1.0, 0.0)), stats["fitness"], stats["inliers"], stats["iterations"])
    return rounded(spark.createDataFrame([row], "nx double, ny double, nz double, d double, fitness double, inliers long, iterations int"), 5)


@query("multi_plane")
def multi_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment_planes(views.vectors(spark, sf_dir), 3, 0.05, threshold=0.3)
    rows = [(i, *facing_up(p), s["fitness"], s["inliers"]) for i, (p, _, s) in enumerate(found)]
    return rounded(spark.createDataFrame(rows, "plane_id int, nx double, ny double, nz double, d double, fitness double, inliers long"), 5)


CLUSTERS_SQL = f"""WITH RECURSIVE v AS ({VECTORS_SQL}), e AS (SELECT a.point_id AS a, b.point_id AS b FROM v a, v b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.16),
 r AS (SELECT a AS point_id, b AS root FROM e UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.point_id), c AS (SELECT point_id, min(root) AS root FROM r GROUP BY point_id),
 s AS (SELECT root, CAST(row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS INT) AS cluster_id FROM c GROUP BY root HAVING count(*) >= 3)"""


@query("euclidean_clusters", f"{CLUSTERS_SQL} SELECT cluster_id, point_id FROM c JOIN s USING (root)")
def euclidean_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.euclidean_clusters(views.vectors(spark, sf_dir), 0.4, 3)


@query("cluster_labels", f"{CLUSTERS_SQL} SELECT v.point_id, CAST(7 * 65536 + coalesce(cluster_id + 1, 0) AS BIGINT) AS label FROM v LEFT JOIN (SELECT * FROM c JOIN s USING (root)) k ON v.point_id = k.point_id")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir)
    return segment.cluster_labels(v, segment.euclidean_clusters(v, 0.4, 3), 7).select("point_id", "label")


BOXES_SQL = ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg")) for c in "xyz")


@query("cluster_boxes", f"{CLUSTERS_SQL} SELECT cluster_id, count(*) AS n, {BOXES_SQL} FROM c JOIN s USING (root) JOIN v ON v.point_id = c.point_id GROUP BY cluster_id")
def cluster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.vectors(spark, sf_dir)
    return rounded(segment.cluster_boxes(v, segment.euclidean_clusters(v, 0.4, 3)))


@query("voxel_lookup", f"""WITH p AS (SELECT *, {', '.join(f'CAST(floor({c} * (1.0 / 2.0)) AS BIGINT) AS v{c}' for c in 'xyz')} FROM ({POINTS_SQL})), m AS (SELECT vx, vy, vz, count(*) AS n, avg(z) AS mz FROM p GROUP BY vx, vy, vz)
SELECT point_id, n AS v_n, round(mz, 6) AS v_mz FROM p JOIN m USING (vx, vy, vz)""")
def voxel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.points(spark, sf_dir)
    return rounded(spatial.voxel_lookup(p, vox.voxel_distributions(p, 2.0), 2.0).select("point_id", "v_n", "v_mz"))


@query("map_upsert", f"""WITH f AS ({FACTS_SQL}), a AS (SELECT "row", "col", min(min_z) AS min_z FROM f WHERE scan_id < 10 GROUP BY ALL), b AS (SELECT "row", "col", min(min_z) AS min_z FROM f WHERE scan_id >= 10 GROUP BY ALL)
SELECT coalesce(b."row", a."row") AS "row", coalesce(b."col", a."col") AS "col", round(coalesce(b.min_z, a.min_z), 6) AS min_z FROM a FULL JOIN b ON a."row" = b."row" AND a."col" = b."col" """)
def map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of the later scans put over that of the earlier ones."""
    f = facts(spark, sf_dir).withColumn("late", F.col("scan_id") >= 10).groupBy("late", "row", "col").agg(F.min("min_z").alias("min_z"))
    return rounded(spatial.upserted(f.where("NOT late").drop("late"), f.where("late").drop("late"), ["min_z"]))


@query("elevation_at", f'SELECT "row", "col", round(elevation, 6) AS elevation FROM ({MAP_SQL}) WHERE "row" = 40 AND "col" = 44')
def elevation_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.elevation_at(terrain(spark, sf_dir), GRID, 4.9, 2.9))


@query("layer_snapshot", f'SELECT "row", "col", round(elevation, 6) AS elevation, round(variance, 6) AS variance FROM ({MAP_SQL})')
def layer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.snapshot(terrain(spark, sf_dir), ["elevation", "variance"]))


@query("cloud_message", f'SELECT CAST(24.75 - "row" * 0.5 AS DOUBLE) AS x, CAST(24.75 - "col" * 0.5 AS DOUBLE) AS y, round(elevation, 6) AS z, n_points FROM ({MAP_SQL})')
def cloud_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(messages.map_points(terrain(spark, sf_dir), GRID).select("x", "y", "z", "n_points"))


# --- rays, poses, registration, maps ----------------------------------------------------------------------------------


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan view with its sensor one metre up at the map's centre."""
    return views.seen(spark, sf_dir).withColumns({"ox": F.lit(0.1), "oy": F.lit(0.1), "oz": F.lit(1.0)})


@query("trace_rays_min_height")
def trace_rays_min_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raycast.ray_heights(beams(spark, sf_dir), GRID))


@query("observed_evidence", f'SELECT CAST(scan_id AS BIGINT) AS scan_id, "row", "col", count(*) AS hits FROM ({CELLED_SQL}) WHERE "row" BETWEEN 0 AND 99 AND "col" BETWEEN 0 AND 99 GROUP BY ALL')
def observed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raycast.observed(views.seen(spark, sf_dir), GRID)


@query("ghost_cells")
def ghost_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beams(spark, sf_dir)
    cells = raycast.evidence(raster.rasterized(b, GRID), b, GRID)
    return rounded(estimate.layers(estimate.fold(cells, visibility=estimate.Visibility())))


TRAJECTORY_SQL = "SELECT user_id, epoch_us(ts) / 1e6 AS ts, event_id, value / 10 AS tx, CAST(event_id % 17 AS DOUBLE) AS ty, 0.0 AS tz FROM events"


@query("trajectory_length", f"SELECT user_id, round(sum(coalesce(step, 0)), 4) AS length, round(max(ts) - min(ts), 4) AS duration FROM (SELECT *, sqrt(power(tx - lag(tx) OVER w, 2) + power(ty - lag(ty) OVER w, 2)) AS step FROM ({TRAJECTORY_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY user_id")
def trajectory_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(asof.trajectory_stats(views.trajectory(spark, sf_dir), ("user_id",)).select("user_id", "length", "duration"), 4)


@query("pose_asof", f"""WITH p AS ({TRAJECTORY_SQL}), q AS (SELECT user_id, event_id, ts + 1000.0 AS ts FROM p)
SELECT q.user_id, q.event_id, round(CASE WHEN b.ts IS NULL OR b.ts <= a.ts THEN a.tx ELSE a.tx + (q.ts - a.ts) / (b.ts - a.ts) * (b.tx - a.tx) END, 4) AS tx
FROM (SELECT q.*, a.ts AS ats FROM q ASOF JOIN p a ON q.user_id = a.user_id AND q.ts >= a.ts) q JOIN p a ON a.user_id = q.user_id AND a.ts = q.ats ASOF LEFT JOIN p b ON q.user_id = b.user_id AND q.ts <= b.ts""")
def pose_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's trajectory is a thousand seconds after each event; the last pose holds beyond the end."""
    t = views.trajectory(spark, sf_dir)
    q = t.select("user_id", (F.col("ts") + 1000.0).alias("ts"), "event_id")
    return rounded(asof.poses_at(q, t, ("user_id",), columns=("tx", "ty", "tz")).select("user_id", "event_id", "tx"), 4)


@query("deskew_linear", f"""WITH p AS ({POINTS_SQL}), a AS (SELECT *, min(t) OVER (PARTITION BY scan_id) AS lo, max(t) OVER (PARTITION BY scan_id) AS hi FROM p)
SELECT point_id, round(x + (t - lo) / (hi - lo) * 2.0 - 2.0, 6) AS x, round(y + (t - lo) / (hi - lo) * 1.0 - 1.0, 6) AS y, round(z, 6) AS z FROM a""")
def deskew_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = [F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    end = [F.lit(v) for v in (2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    return ids(asof.deskewed(views.points(spark, sf_dir), still, end))


def _moved_copy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = views.vectors(spark, sf_dir)
    return transformed(v, Rigid.from_rpy(0.0, 0.0, 0.02, (0.05, -0.03, 0.02))), v


def _register(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    source, target = _moved_copy(spark, sf_dir)
    if method == "plane":
        target = normals.with_normals(target, 10)
    elif method in ("gicp", "vgicp"):
        source, target = (normals.with_normals(c, 10, covariances=True) for c in (source, target))
    found = register.align(source, target, method)
    names = [f"r{i}{j}" if j < 3 else f"t{i}" for i in range(3) for j in range(4)]
    row = spark.createDataFrame([(*map(float, found.transform[:3].ravel()), float(found.fitness))], ", ".join(f"{n} double" for n in [*names, "fitness"]))
    return rounded(row, 3)


@query("icp_step", f"""WITH t AS ({VECTORS_SQL}), s AS (SELECT point_id, x + 0.05 AS x, y AS y, z AS z FROM t), p AS (SELECT s.*, t.x AS qx, t.y AS qy, t.z AS qz, row_number() OVER (PARTITION BY s.point_id ORDER BY (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z), t.point_id) AS k, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS d2 FROM s, t)
SELECT round(sum(z * z + y * y), 3) AS h33, round(sum(x - qx), 3) AS b0, round(sum(d2), 3) AS error, count(*) AS n FROM p WHERE k = 1 AND d2 < 1.0""")
def icp_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear system of one point-to-point round, as one aggregate row."""
    t = views.vectors(spark, sf_dir)
    pairs = register.correspondences(t.withColumn("x", F.col("x") + 0.05), t, 1.0)
    return rounded(pairs.agg(*register.linearized(pairs, "point", register.Settings())).select("h33", "b0", "error", "n"), 3)


def scan_mapper(spark: SparkSession, mode: str) -> Mapper:
    """Scans from a sensor that moves a metre along x between them."""
    extrinsics = spark.createDataFrame([("lidar", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "frame_id string, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    poses = spark.range(20).select(F.col("id").cast("double").alias("ts"), F.col("id").cast("double").alias("tx"), *[F.lit(v).alias(n) for n, v in (("ty", 0.0), ("tz", 0.0), ("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    size = 100.0 if mode == "global" else 20.0
    config = Mapping(mode=mode, sensor=Lidar(), point_filter=PointFilter(0.1, 0.9, 0.5, 20.0), length_x=size, length_y=size, resolution=0.5)
    return Mapper(config).with_providers(extrinsics, poses, 0.5)


def timed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.points(spark, sf_dir).withColumns({"frame_id": F.lit("lidar"), "scan_ts": F.col("scan_id").cast("double")})


MAP_LAYERS = ("row", "col", "elevation", "n_points", "elevation_min", "elevation_max", "obstacle", "intensity", "color")


def _map(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return rounded(scan_mapper(spark, mode).mapped(timed_scans(spark, sf_dir)).select(*MAP_LAYERS))


@query("global_map")
def global_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "global")


@query("local_window_map")
def local_window_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir, "local")


@query("postprocess_map")
def postprocess_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion, inpainting and terrain features in the order of the node's post-processing."""
    cells = terrain(spark, sf_dir).select("row", "col", "elevation", F.col("elevation_min").alias("lower_bound"), F.col("elevation_max").alias("upper_bound"))
    asked = Postprocess(inpaint=True, fuse=True, features=True, fusion_radius=1.0, fusion_sigma=0.5, feature_radius=1.0)
    return upright(postprocessed(cells, GRID, asked), 4)


# --- files and streams ------------------------------------------------------------------------------------------------

NUMBERED_SQL = f"SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id) - 1 AS point_id, x, y, z, intensity, color FROM ({POINTS_SQL})"


def _files_of(spark: SparkSession, sf_dir: str, kind: str, *channels: str, **options: object) -> DataFrame:
    """Each scan as the bytes of one file, named by the scan; in pieces, so that a scan of any size passes."""
    made = clouds.encoded(views.points(spark, sf_dir).select("scan_id", "point_id", "x", "y", "z", *channels), kind, piece=PIECE, **options)
    return made.select(F.col("scan_id").cast("string").alias("path"), "piece", "content")


@query("pcd_round_trip", f"SELECT scan_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(intensity, 4) AS intensity, color FROM ({NUMBERED_SQL})")
def pcd_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = clouds.decoded_pcd(_files_of(spark, sf_dir, "pcd", "intensity", "color"))
    return rounded(back.select(F.col("file").cast("int").alias("scan_id"), "point_id", "x", "y", "z", "intensity", "color"), 4)


@query("bin_round_trip", f"SELECT scan_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(intensity, 4) AS intensity FROM ({NUMBERED_SQL})")
def bin_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = clouds.decoded_bin(_files_of(spark, sf_dir, "bin", "intensity"))
    return rounded(back.select(F.col("file").cast("int").alias("scan_id"), "point_id", "x", "y", "z", "intensity"), 4)


@query("tum_round_trip", "SELECT epoch_us(ts) AS micros, round(value / 10, 4) AS tx, round(sin(value / 1000), 4) AS qz FROM events")
def tum_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tum-{uuid.uuid4().hex}"
    trajectories.write_tum(views.trajectory(spark, sf_dir), path)
    return rounded(trajectories.read_tum(spark, path).select(F.round(F.col("ts") * 1_000_000).cast("long").alias("micros"), "tx", "qz"), 4)


from . import catalog_twins  # noqa: E402,F401  the rest of the registry, and the twins of queries above

__all__ = ["ORACLES", "QUERIES", "Grid", "flagship"]
