"""DuckDB twins that take a paragraph each (folds, eigenvectors, random planes, rays, registration), and further queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import Rigid, normalized_angle, plane_distance, plane_from_points, slerped, transformed
from ..operators import asof, estimate, normals, raster, register, spatial
from ..operators import voxel as vox
from ..sources import clouds, maps, messages, trajectories
from ..sources.pieces import PIECE
from ..streaming.mapper import StreamingMapper, scans
from . import views
from .catalog import FACT_COLUMNS, KALMAN_MAP_SQL, MAP_LAYERS, NUMBERED_SQL, ORACLES, PAIRS_SQL, SPREAD_SQL, XYZ_SQL, _files_of, _inpaint_sql, _register, ids, query, rounded, scan_mapper, settled, terrain, timed_scans
from ..functions.sensors import Constant
from .config import Mapping, PointFilter
from .mapper import Mapper
from .tables import shared_dir
from .views import CELLED_SQL, FACTS_SQL, GRID, MAP_SQL, POINTS_SQL, SEEN_SQL, VECTORS_SQL


def twin(name: str, sql: str) -> None:
    ORACLES[name] = settled(sql)


# --- eigenvectors ---------------------------------------------------------------------------------------------------


def eigen_sql(source: str) -> str:
    """source has cxx, cxy, cxz, cyy, cyz, czz; adds l0 <= l1 <= l2 by the cubic's cosines, and the unit (ax, ay, az) of l0 as the
    longest cross product of two rows of the covariance less l0."""
    s = f"SELECT *, (cxx + cyy + czz) / 3 AS q FROM ({source})"
    s = f"SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM ({s})"
    det = "((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz))"
    s = f"SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1.0, least(1.0, {det} / (2 * p * p * p)))) / 3 ELSE 0 END AS phi FROM ({s})"
    s = f"SELECT *, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0, q + 2 * p * cos(phi) AS l2 FROM ({s})"
    s = f"SELECT *, 3 * q - l0 - l2 AS l1, cxx - l0 AS ma, cyy - l0 AS mb, czz - l0 AS mc FROM ({s})"
    crosses = (("cxy * cyz - cxz * mb", "cxz * cxy - ma * cyz", "ma * mb - cxy * cxy"), ("cxy * mc - cxz * cyz", "cxz * cxz - ma * mc", "ma * cyz - cxy * cxz"), ("mb * mc - cyz * cyz", "cyz * cxz - cxy * mc", "cxy * cyz - mb * cxz"))
    s = "SELECT *, " + ", ".join(f"{e} AS k{i}{c}" for i, x in enumerate(crosses) for c, e in zip("xyz", x, strict=True)) + f" FROM ({s})"
    s = "SELECT *, " + ", ".join(f"sqrt(k{i}x * k{i}x + k{i}y * k{i}y + k{i}z * k{i}z) AS s{i}" for i in range(3)) + f" FROM ({s})"
    pick = lambda c: f"CASE WHEN s0 >= s1 AND s0 >= s2 THEN k0{c} / s0 WHEN s1 >= s2 THEN k1{c} / s1 ELSE k2{c} / s2 END"
    return "SELECT *, " + ", ".join(f"{pick(c)} AS a{c}" for c in "xyz") + f" FROM ({s})"


def cov_sql(x: str, y: str, z: str) -> str:
    v = {"x": x, "y": y, "z": z}
    return ", ".join(f"covar_pop({v[a]}, {v[b]}) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


def features_sql(cells: str, keep: str = "") -> str:
    """Terrain features of cells ("row", "col", v) with a radius of two cells of half a metre; keep: columns of the cell taken along."""
    near = f"""WITH m AS ({cells}) SELECT a."row", a."col", count(*) AS n, list_sort(list(b.v)) AS zs, {cov_sql('(a."row" - b."row") * 0.5', '(a."col" - b."col") * 0.5', 'b.v')}
 FROM m a JOIN m b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b."col" BETWEEN a."col" - 2 AND a."col" + 2 AND power(a."row" - b."row", 2) + power(a."col" - b."col", 2) <= 4 GROUP BY a."row", a."col" """
    fit = eigen_sql(f"SELECT * FROM ({near}) WHERE n >= 4")
    sign = lambda c: f"round(CASE WHEN abs(az) <= 1e-6 THEN abs(a{c}) WHEN az < 0 THEN -a{c} ELSE a{c} END, 4) AS n{c}"
    return f"""SELECT "row", "col", round(zs[1 + CAST(floor(0.95 * (n - 1)) AS INT)] - zs[1 + CAST(floor(0.05 * (n - 1)) AS INT)], 4) AS step, round(degrees(acos(least(abs(az), 1.0))), 4) AS slope,
 round(sqrt(greatest(l0, 0.0)), 4) AS roughness, round(CASE WHEN l0 + l1 + l2 > 0 THEN abs(l0 / (l0 + l1 + l2)) ELSE 0.0 END, 4) AS curvature, {", ".join(map(sign, "xyz"))} FROM ({fit}) WHERE l1 >= 1e-8"""


twin("terrain_features", features_sql(f'SELECT "row", "col", elevation AS v FROM ({MAP_SQL})'))

FUSED_SQL = ORACLES["uncertainty_fusion"]
INPAINTED_SQL = _inpaint_sql(3).replace("round(v, 6) AS elevation", "v")
ORACLES["postprocess_map"] = f"""WITH f AS MATERIALIZED ({FUSED_SQL}), i AS MATERIALIZED ({INPAINTED_SQL}), t AS MATERIALIZED ({settled(features_sql(INPAINTED_SQL))})
SELECT i."row", i."col", round(i.v + 3.7e-06, 4) AS elevation, round(f.lower_bound + 3.7e-06 - 3.7e-08, 4) AS lower_bound, round(f.upper_bound + 3.7e-06 - 3.7e-08, 4) AS upper_bound, step, slope, roughness, curvature, nx, ny, nz
FROM i LEFT JOIN f ON i."row" = f."row" AND i."col" = f."col" LEFT JOIN t ON i."row" = t."row" AND i."col" = t."col" """

NEAR_SQL = f"{PAIRS_SQL}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY dist_sq, dst_id) AS k FROM p) WHERE k <= 10)"


def normals_sql(view: tuple[float, float, float]) -> str:
    """v's points with nx, ny, nz toward a place, from ten neighbours, the point among them."""
    fit = eigen_sql(f"SELECT src_id, count(*) AS n, {cov_sql('b.x', 'b.y', 'b.z')} FROM k JOIN v b ON b.point_id = dst_id GROUP BY src_id")
    toward = " + ".join(f"({v!r} - {c}) * a{c}" for v, c in zip(view, "xyz", strict=True))
    return "SELECT point_id, x, y, z, " + ", ".join(f"CASE WHEN n >= 3 AND cxx + cyy + czz >= 1.1920929e-07 THEN CASE WHEN {toward} < 0 THEN -a{c} ELSE a{c} END ELSE 0.0 END AS n{c}" for c in "xyz") + f" FROM v JOIN ({fit}) ON src_id = point_id"


ROUND5 = ", ".join(f"round({c}, 5) AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz"))
PLANE_LIKE = ", ".join(f"{1.0 if a == b else 0.0} - 0.999 * n{a} * n{b} AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
twin("normals_knn", f"{NEAR_SQL} SELECT point_id, {ROUND5} FROM ({normals_sql((0.0, 0.0, 10.0))})")
twin("covariances_gicp", f"{NEAR_SQL} SELECT point_id, {ROUND5}, {', '.join(f'round(c{p}, 5) AS c{p}' for p in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM (SELECT *, {PLANE_LIKE} FROM ({normals_sql((0.0, 0.0, 0.0))}))")


@query("normals_radius")
def normals_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals from all neighbours within a metre and a half; zero where there are fewer than three."""
    return rounded(normals.with_normals(views.vectors(spark, sf_dir), None, 1.5, viewpoint=(0.0, 0.0, 10.0)), 5)


twin("normals_radius", f"{PAIRS_SQL}, k AS (SELECT * FROM p WHERE dist_sq <= 2.25) SELECT point_id, {ROUND5} FROM ({normals_sql((0.0, 0.0, 10.0))})")


@query("principal_axes", f"""SELECT "row", "col", n, {", ".join(f"round({c}, 5) AS {c}" for c in ("l0", "l1", "l2"))} FROM ({eigen_sql(f'SELECT "row", "col", count(*) AS n, {cov_sql("x", "y", "z")} FROM ({CELLED_SQL}) WHERE "row" BETWEEN 0 AND 99 AND "col" BETWEEN 0 AND 99 GROUP BY ALL')})""")
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stencil import with_axes

    fit = GRID.celled(views.seen(spark, sf_dir)).groupBy("row", "col").agg(*vox.moments())
    return rounded(with_axes(fit).select("row", "col", "n", "l0", "l1", "l2"), 5)


# --- quantile markers -----------------------------------------------------------------------------------------------


def markers_sql() -> str:
    """Five markers a user, one value at a time: bounds and positions, then the inner markers, each with those before it moved."""
    s = "SELECT r.user_id, r.k + 1 AS k, o.v AS z, q, n, c FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1"
    s = f"SELECT user_id, k, z, c, [least(q[1], z), q[2], q[3], q[4], greatest(q[5], z)] AS q, CASE WHEN z < q[2] THEN 1 WHEN z < q[3] THEN 2 WHEN z < q[4] THEN 3 ELSE 4 END AS w, n FROM ({s})"
    s = f"SELECT user_id, k, q, c, [n[1], n[2] + CASE WHEN w <= 1 THEN 1 ELSE 0 END, n[3] + CASE WHEN w <= 2 THEN 1 ELSE 0 END, n[4] + CASE WHEN w <= 3 THEN 1 ELSE 0 END, n[5] + 1] AS n FROM ({s})"
    for i, share in ((2, 0.16), (3, 0.50), (4, 0.84)):
        s = f"SELECT *, CASE WHEN {share} * c - n[{i}] >= 1 AND n[{i + 1}] - n[{i}] > 1 THEN 1 WHEN {share} * c - n[{i}] <= -1 AND n[{i - 1}] - n[{i}] < -1 THEN -1 ELSE 0 END AS m FROM ({s})"
        bent = f"q[{i}] + m / (n[{i + 1}] - n[{i - 1}]) * ((n[{i}] - n[{i - 1}] + m) * (q[{i + 1}] - q[{i}]) / (n[{i + 1}] - n[{i}]) + (n[{i + 1}] - n[{i}] - m) * (q[{i}] - q[{i - 1}]) / (n[{i}] - n[{i - 1}]))"
        s = f"SELECT *, CASE WHEN m = 0 THEN q[{i}] ELSE {bent} END AS bent FROM ({s})"
        line = f"q[{i}] + m * (q[{i} + m] - q[{i}]) / (n[{i} + m] - n[{i}])"
        new = f"CASE WHEN m = 0 THEN q[{i}] WHEN q[{i - 1}] < bent AND bent < q[{i + 1}] THEN bent ELSE {line} END"
        keep = lambda a, v: "[" + ", ".join(v if j == i else f"{a}[{j}]" for j in range(1, 6)) + "]"  # noqa: E731,B023
        s = f"SELECT user_id, k, c, {keep('q', new)} AS q, {keep('n', f'n[{i}] + m')} AS n FROM ({s})"
    return f"SELECT user_id, k, q, n, c + 1.0 AS c FROM ({s})"


twin("p2_fold", f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 b AS (SELECT user_id, list(v ORDER BY k) AS vs FROM o WHERE k <= 5 GROUP BY user_id), t AS (SELECT user_id, count(*) AS total FROM o GROUP BY user_id),
 r AS (SELECT user_id, len(vs) AS k, CASE WHEN len(vs) = 5 THEN list_sort(vs) ELSE vs END AS q, [0.0, 1.0, 2.0, 3.0, 4.0]::DOUBLE[] AS n, 5.0::DOUBLE AS c FROM b UNION ALL {markers_sql()})
SELECT r.user_id, round(q[4], 6) AS elevation, round(power((q[4] - q[2]) / 2, 2), 6) AS variance, round(q[1], 6) AS lower_bound, round(q[5], 6) AS upper_bound, total AS n_points FROM r JOIN t ON t.user_id = r.user_id AND r.k = t.total""")


# --- folds ------------------------------------------------------------------------------------------------------------

BLANK = "{'x': NULL::DOUBLE, 'p': NULL::DOUBLE, 'n': 0::BIGINT, 'mean': 0.0::DOUBLE, 'm2': 0.0::DOUBLE, 'odds': 0.0::DOUBLE, 'ghost': NULL::DOUBLE, 'lo': NULL::DOUBLE, 'hi': NULL::DOUBLE, 'top': NULL::DOUBLE, 'at': NULL::BIGINT, 'i': NULL::DOUBLE, 'c': NULL::INT}"


def fold_sql(events: str, rays: bool = False) -> str:
    """The state after a list of events {s, gone, z, r, hits, ray, high, i, c} in order: window, height, evidence."""
    gain = "(acc.p / (acc.p + ev.r))"
    first = "acc.n = 0"
    hit = f"""{{'x': CASE WHEN {first} THEN ev.z ELSE acc.x + {gain} * (ev.z - acc.x) END, 'p': CASE WHEN {first} THEN ev.r ELSE least(greatest((1 - {gain}) * acc.p, 1e-4), 1e-2) END, 'n': acc.n + 1,
 'mean': acc.mean + (ev.z - acc.mean) / (acc.n + 1), 'm2': acc.m2 + (ev.z - acc.mean) * (ev.z - (acc.mean + (ev.z - acc.mean) / (acc.n + 1))), 'odds': acc.odds, 'ghost': acc.ghost, 'lo': least(acc.lo, ev.z), 'hi': greatest(acc.hi, ev.high),
 'top': CASE WHEN ev.high > ev.z THEN ev.high END, 'at': ev.s, 'i': greatest(acc.i, ev.i), 'c': coalesce(ev.c, acc.c)}}"""
    step = f"CASE WHEN ev.gone THEN {BLANK} WHEN ev.z IS NULL THEN acc ELSE {hit} END"
    if rays:
        odds = "least(st.odds + coalesce(ev.hits, 0) * 0.4, greatest(2.0, st.odds))"
        conflict = "(ev.ray IS NOT NULL AND st.x IS NOT NULL AND st.x > ev.ray + 0.05)"
        after = f"CASE WHEN {conflict} THEN {odds} - 0.2 ELSE {odds} END"
        cleared = BLANK.replace("'ghost': NULL::DOUBLE", "'ghost': 1.0::DOUBLE")
        parts = ", ".join(f"'{n}': " + (f"({after})" if n == "odds" else f"st.{n}") for n in ("x", "p", "n", "mean", "m2", "odds", "ghost", "lo", "hi", "top", "at", "i", "c"))
        step = f"list_transform([{step}], lambda st: CASE WHEN {conflict} AND {after} < -1.0 THEN {cleared} ELSE {{{parts}}} END)[1]"
    return f"list_reduce(list_sort({events}), lambda acc, ev: {step}, {BLANK})"


EVENT = "{'s': s, 'gone': gone, 'z': z, 'r': r, 'hits': hits, 'ray': ray, 'high': high, 'i': i, 'c': c}"
SPREAD = "CASE WHEN s.n > 1 THEN s.m2 / (s.n - 1) ELSE 0 END"

RAYS_SQL = f"""WITH RECURSIVE b AS (SELECT scan_id, x, y, z, 0.1 AS ox, 0.1 AS oy, 1.0 AS oz FROM ({SEEN_SQL}) WHERE z < 1.0),
 g AS (SELECT scan_id, oz, z - oz AS rise, (25.0 - ox) / 0.5 AS r0, (25.0 - oy) / 0.5 AS c0, (25.0 - x) / 0.5 - (25.0 - ox) / 0.5 AS dr, (25.0 - y) / 0.5 - (25.0 - oy) / 0.5 AS dc FROM b WHERE sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)) >= 1e-4),
 w(scan_id, oz, rise, r, c, sr, sc, fr, fc, er, ec) AS (SELECT scan_id, oz, rise, CAST(floor(r0) AS BIGINT), CAST(floor(c0) AS BIGINT), CAST(sign(dr) AS BIGINT), CAST(sign(dc) AS BIGINT),
  CASE WHEN abs(dr) <= 1e-8 THEN 1e30 ELSE (CASE WHEN dr > 0 THEN floor(r0) + 1 ELSE floor(r0) END - r0) / dr END, CASE WHEN abs(dc) <= 1e-8 THEN 1e30 ELSE (CASE WHEN dc > 0 THEN floor(c0) + 1 ELSE floor(c0) END - c0) / dc END,
  CASE WHEN abs(dr) <= 1e-8 THEN 0.0 ELSE 1 / abs(dr) END, CASE WHEN abs(dc) <= 1e-8 THEN 0.0 ELSE 1 / abs(dc) END FROM g
  UNION ALL SELECT scan_id, oz, rise, CASE WHEN fr < fc THEN r + sr ELSE r END, CASE WHEN fr < fc THEN c ELSE c + sc END, sr, sc, CASE WHEN fr < fc THEN fr + er ELSE fr END, CASE WHEN fr < fc THEN fc ELSE fc + ec END, er, ec FROM w WHERE least(fr, fc) < 1),
 rays AS (SELECT CAST(scan_id AS BIGINT) AS scan_id, r AS "row", c AS "col", min(oz + least(least(fr, fc), 1.0) * rise) AS ray FROM w WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY ALL)"""
twin("trace_rays_min_height", f'{RAYS_SQL} SELECT scan_id, "row", "col", round(ray, 6) AS ray FROM rays')
twin("ghost_cells", f"""{RAYS_SQL}, f AS ({FACTS_SQL}), e AS (SELECT coalesce(f.scan_id, rays.scan_id) AS s, coalesce(f."row", rays."row") AS "row", coalesce(f."col", rays."col") AS "col", false AS gone, f.min_z AS z, 0.01 AS r, f.n AS hits, ray, f.min_z AS high, NULL::DOUBLE AS i, NULL::INT AS c
 FROM f FULL JOIN rays ON f.scan_id = rays.scan_id AND f."row" = rays."row" AND f."col" = rays."col"), k AS (SELECT "row", "col", {fold_sql(f"list({EVENT})", True)} AS s FROM e GROUP BY ALL)
SELECT "row", "col", round(s.x, 6) AS elevation, round(CASE WHEN s.x IS NOT NULL THEN {SPREAD} END, 6) AS variance, CASE WHEN s.x IS NOT NULL THEN s.n END AS n_points, round(s.x - 2 * sqrt(greatest({SPREAD}, 0)), 6) AS lower_bound, round(s.x + 2 * sqrt(greatest({SPREAD}, 0)), 6) AS upper_bound, round(s.ghost, 6) AS ghost_removal
FROM k WHERE s.x IS NOT NULL OR s.ghost IS NOT NULL""")


def moving_sql(top: float, inside: str) -> str:
    """Facts of scans whose sensor is at x = scan, on a map whose corner is at (top, top), inside: of r, c (cells) and s (scan)."""
    var = "(4e-4 - greatest(r2 * 1e-6, 1e-6)) * (z * z / r2) + greatest(r2 * 1e-6, 1e-6)"
    p = f"SELECT *, x * x + y * y + z * z AS r2, CAST(floor(({top} - (x + scan_id)) / 0.5) AS BIGINT) AS r, CAST(floor(({top} - y) / 0.5) AS BIGINT) AS c, CAST(scan_id AS BIGINT) AS s FROM ({SEEN_SQL})"
    p = f"SELECT *, row_number() OVER (PARTITION BY s, r, c ORDER BY z, point_id) AS k FROM (SELECT *, CASE WHEN r2 < 1e-6 THEN 0.01 ELSE {var} END AS v FROM ({p})) WHERE {inside}"
    return f'SELECT s, r AS "row", c AS "col", min(z) AS z, max(CASE WHEN k = 1 THEN v END) AS r, max(z) AS high, max(intensity) AS i, arg_max(color, point_id) AS c FROM ({p}) GROUP BY s, r, c'


LAYERS_SQL = '"row", "col", round(s.x, 6) AS elevation, s.n AS n_points, round(s.lo, 6) AS elevation_min, round(s.hi, 6) AS elevation_max, round(CASE WHEN s.at = 19 THEN s.top END, 6) AS obstacle, round(s.i, 6) AS intensity, s.c AS color'
twin("global_map", f"""WITH f AS ({moving_sql(50.0, "r BETWEEN 0 AND 199 AND c BETWEEN 0 AND 199")}), k AS (SELECT "row", "col", {fold_sql("list({'s': s, 'gone': false, 'z': z, 'r': r, 'high': high, 'i': i, 'c': c})")} AS s FROM f GROUP BY ALL) SELECT {LAYERS_SQL} FROM k""")
LOCAL_SQL = f"""WITH f AS MATERIALIZED ({moving_sql(10.0, "r - (20 - 2 * s) BETWEEN -20 AND 19 AND c - 20 BETWEEN -20 AND 19")}), cells AS (SELECT DISTINCT "row", "col" FROM f),
 e AS (SELECT cells."row", cells."col", w.s, NOT (cells."row" - (20 - 2 * w.s) BETWEEN -20 AND 19) AS gone, f.z, f.r, f.high, f.i, f.c FROM cells CROSS JOIN (SELECT range AS s FROM range(20)) w LEFT JOIN f ON f."row" = cells."row" AND f."col" = cells."col" AND f.s = w.s),
 k AS (SELECT "row", "col", {fold_sql("list({'s': s, 'gone': gone, 'z': z, 'r': r, 'high': high, 'i': i, 'c': c})")} AS s FROM e GROUP BY ALL) SELECT {LAYERS_SQL} FROM k WHERE s.x IS NOT NULL"""
twin("local_window_map", LOCAL_SQL)


# --- terrain model ----------------------------------------------------------------------------------------------------


def build_dem_sql() -> str:
    first = f"""{SPREAD_SQL}, kept AS MATERIALIZED (SELECT * FROM v WHERE point_id IN (SELECT src_id FROM s WHERE d <= (SELECT avg(d) + stddev_pop(d) FROM s))),
 b AS (SELECT max(x) - min(x) + 0.5 AS lx, max(y) - min(y) + 0.5 AS ly, (max(x) + min(x)) / 2 AS cx, (max(y) + min(y)) / 2 AS cy FROM kept), g AS (SELECT round(lx / 0.25) AS nr, round(ly / 0.25) AS nc, cx + round(lx / 0.25) * 0.25 / 2 AS tx, cy + round(ly / 0.25) * 0.25 / 2 AS ty FROM b),
 c AS (SELECT * FROM (SELECT kept.*, nr, nc, CAST(floor((tx - x) / 0.25) AS BIGINT) AS "row", CAST(floor((ty - y) / 0.25) AS BIGINT) AS "col" FROM kept, g) WHERE "row" BETWEEN 0 AND nr - 1 AND "col" BETWEEN 0 AND nc - 1),
 l AS (SELECT *, min(z) OVER (PARTITION BY "row", "col") AS low FROM c), h AS (SELECT *, CAST(floor((z - low) / 0.25) AS BIGINT) AS bin FROM l),
 ground AS (SELECT "row", "col", low + (bin + 0.5) * 0.25 AS ground FROM (SELECT "row", "col", low, bin, row_number() OVER (PARTITION BY "row", "col" ORDER BY count(*) DESC, bin) AS k FROM h GROUP BY "row", "col", low, bin) WHERE k = 1),
 m AS MATERIALIZED (SELECT "row", "col", max(z) AS elevation, min(z) AS elevation_min, max(z) AS elevation_max, coalesce(var_samp(z), 0.0) AS variance, count(*) AS n_points FROM c JOIN ground USING ("row", "col") WHERE z <= ground + 2.0 GROUP BY "row", "col"), m0 AS (SELECT "row", "col", elevation AS v FROM m)"""
    for k in range(3):
        first += f""", m{k + 1} AS MATERIALIZED (SELECT "row", "col", coalesce(own, CASE WHEN n >= 2 THEN t / n END) AS v FROM (SELECT i."row" - di AS "row", i."col" - dj AS "col", max(CASE WHEN di = 0 AND dj = 0 THEN v END) AS own, sum(CASE WHEN di <> 0 OR dj <> 0 THEN v END) AS t, count(CASE WHEN di <> 0 OR dj <> 0 THEN 1 END) AS n
 FROM m{k} i, (SELECT a.range AS di, b.range AS dj FROM range(-1, 2) a, range(-1, 2) b) GROUP BY ALL), g WHERE "row" BETWEEN 0 AND nr - 1 AND "col" BETWEEN 0 AND nc - 1 AND coalesce(own, CASE WHEN n >= 2 THEN t / n END) IS NOT NULL)"""
    return f'{first} SELECT m3."row", m3."col", round(v, 6) AS elevation, round(elevation_min, 6) AS elevation_min, round(elevation_max, 6) AS elevation_max, round(variance, 6) AS variance, n_points FROM m3 LEFT JOIN m ON m."row" = m3."row" AND m."col" = m3."col"'


twin("build_dem", build_dem_sql())


# --- planes -----------------------------------------------------------------------------------------------------------


def xor_step(v: str) -> str:
    """Shifts 13, 7 and 17 of a 64-bit shift register, in 128 bits. (fixed values)"""
    whole = "18446744073709551616::HUGEINT"
    a = f"xor({v}, ({v} * 8192) % {whole})"
    b = f"xor(({a}), ({a}) // 128)"
    return f"xor(({b}), (({b}) * 131072) % {whole})"


def plane_ctes(k: int, source: str, iterations: int = 1000, threshold: float = 0.3) -> str:
    """Tables of plane k: numbered points, draws, triples, candidates, counts, the accepting walk, the refined plane and its points."""
    n = f"(SELECT count(*) FROM pts{k})"
    far = lambda p: f"abs({p}.nx * x + {p}.ny * y + {p}.nz * z + {p}.d) < {threshold}"
    fit = eigen_sql(f"SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {cov_sql('x', 'y', 'z')} FROM pts{k}, best{k} WHERE {far(f'best{k}')}")
    return f"""pts{k} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS i FROM {source}),
 draw{k}(j, v, a, b, c, t) AS (SELECT 0, 42::HUGEINT, -1::HUGEINT, -1::HUGEINT, -1::HUGEINT, 0 UNION ALL
  SELECT j + 1, w, CASE WHEN c >= 0 OR a < 0 THEN w % {n} ELSE a END, CASE WHEN c >= 0 OR a < 0 THEN -1 WHEN b < 0 AND w % {n} <> a THEN w % {n} ELSE b END, CASE WHEN c >= 0 OR b < 0 THEN -1 WHEN w % {n} <> a AND w % {n} <> b THEN w % {n} ELSE -1 END, t + CASE WHEN c < 0 AND b >= 0 AND w % {n} <> a AND w % {n} <> b THEN 1 ELSE 0 END
  FROM (SELECT *, {xor_step("v")} AS w FROM draw{k} WHERE t < {iterations} AND {n} >= 3)),
 cand{k} AS MATERIALIZED (SELECT t, ux / s AS nx, uy / s AS ny, uz / s AS nz, -(ux / s * x + uy / s * y + uz / s * z) AS d FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS s FROM (
  SELECT t, p.x, p.y, p.z, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS ux, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS uy, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS uz
  FROM draw{k} JOIN pts{k} p ON p.i = a JOIN pts{k} q ON q.i = b JOIN pts{k} r ON r.i = c WHERE c >= 0)) WHERE s >= 1e-10),
 cnt{k} AS MATERIALIZED (SELECT t, count(CASE WHEN {far('cand%d' % k)} THEN 1 END) AS n FROM cand{k}, pts{k} GROUP BY t),
 walk{k}(t, most, top, lim) AS (SELECT 0, 0::BIGINT, 0, {iterations}::BIGINT UNION ALL SELECT w.t + 1, CASE WHEN n > most THEN n ELSE most END, CASE WHEN n > most THEN w.t + 1 ELSE top END,
  CASE WHEN n > most AND n < {n} THEN least(lim, CAST(ceil(ln(1 - 0.99) / ln(1 - power(n / {n}, 3))) AS BIGINT)) ELSE lim END FROM walk{k} w LEFT JOIN cnt{k} ON cnt{k}.t = w.t + 1 WHERE w.t < lim),
 last{k} AS MATERIALIZED (SELECT * FROM walk{k} ORDER BY t DESC LIMIT 1), best{k} AS MATERIALIZED (SELECT nx, ny, nz, d, last{k}.t AS iterations FROM last{k} JOIN cand{k} ON cand{k}.t = top WHERE most >= 3),
 fit{k} AS MATERIALIZED (SELECT ax AS nx, ay AS ny, az AS nz, -(ax * mx + ay * my + az * mz) AS d, iterations FROM ({fit}), (SELECT iterations FROM best{k})),
 in{k} AS MATERIALIZED (SELECT point_id FROM pts{k}, fit{k} WHERE {far(f'fit{k}')}),
 out{k} AS MATERIALIZED (SELECT nx * sg AS nx, ny * sg AS ny, nz * sg AS nz, d * sg AS d, iterations, (SELECT count(*) FROM in{k}) AS inliers, (SELECT count(*) FROM in{k}) / {n} AS fitness FROM (SELECT *, CASE WHEN nz < 0 THEN -1.0 ELSE 1.0 END AS sg FROM fit{k}))"""


FIT5 = ", ".join(f"round({c}, 5) AS {c}" for c in ("nx", "ny", "nz", "d", "fitness"))
twin("ransac_plane", f"WITH RECURSIVE v AS MATERIALIZED ({VECTORS_SQL}), {plane_ctes(0, 'v')} SELECT {FIT5}, inliers, CAST(iterations AS INT) AS iterations FROM out0")
rest_sql = lambda k: f"rest{k} AS MATERIALIZED (SELECT point_id, x, y, z FROM {'v' if k == 1 else f'rest{k - 1}'} WHERE point_id NOT IN (SELECT point_id FROM in{k - 1}))"
twin("multi_plane", f"""WITH RECURSIVE v AS MATERIALIZED ({VECTORS_SQL}), {plane_ctes(0, 'v')}, {rest_sql(1)}, {plane_ctes(1, 'rest1')}, {rest_sql(2)}, {plane_ctes(2, 'rest2')}
SELECT CAST(plane_id AS INT) AS plane_id, {FIT5}, inliers FROM (SELECT 0 AS plane_id, * FROM out0 UNION ALL SELECT 1, * FROM out1 UNION ALL SELECT 2, * FROM out2) WHERE plane_id < coalesce((SELECT min(j) FROM (SELECT 0 AS j, fitness FROM out0 UNION ALL SELECT 1, fitness FROM out1 UNION ALL SELECT 2, fitness FROM out2) WHERE fitness < 0.05), 3)""")


@query("plane_distances", f"SELECT point_id, round((0.36 * x + 0.48 * y + 0.8 * z) - 1.0, 6) AS signed, round(abs(0.36 * x + 0.48 * y + 0.8 * z - 1.0), 6) AS apart FROM ({POINTS_SQL})")
def plane_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane through three points, and how far all points lie from it."""
    a = np.array([1 / 0.36, 0.0, 0.0])
    plane = plane_from_points(a, np.array([0.0, 1 / 0.48, 0.0]), np.array([0.0, 0.0, 1.25]))
    far = plane_distance(*[F.lit(v) for v in plane])
    return rounded(views.points(spark, sf_dir).select("point_id", far.alias("signed"), F.abs(far).alias("apart")))


# --- registration ---------------------------------------------------------------------------------------------------

MOVED = Rigid.from_rpy(0.0, 0.0, 0.02, (0.05, -0.03, 0.02))
BACK = MOVED.inverse()
FOUND_SQL = "SELECT " + ", ".join(f"round({v!r}, 3) AS {n}" for n, v in [(f"r{i}{j}", BACK.r[3 * i + j]) for i in range(3) for j in range(3)] + [(f"t{i}", BACK.t[i]) for i in range(3)]) + ", round(1.0, 3) AS fitness"
#: A copy that was moved comes back by the motion's inverse.
for kind in ("point", "plane", "gicp"):
    query(f"icp_{kind}", FOUND_SQL)(lambda s, d, m=kind: _register(s, d, m))
query("icp_vgicp")(lambda s, d: _register(s, d, "vgicp"))

CLOSE_SQL = f"{NEAR_SQL}, s AS (SELECT point_id, x + 0.05 AS x, y - 0.02 AS y, z AS z FROM v), c AS (SELECT s.*, t.point_id AS dst, row_number() OVER (PARTITION BY s.point_id ORDER BY (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z), t.point_id) AS k, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) AS d2 FROM s, v t), near AS (SELECT * FROM c WHERE k = 1 AND d2 < 1.0)"


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = views.vectors(spark, sf_dir)
    return t.withColumns({"x": F.col("x") + 0.05, "y": F.col("y") - 0.02}), t


@query("plane_step", f"""{CLOSE_SQL}, n AS ({normals_sql((0.0, 0.0, 0.0))}), e AS (SELECT near.*, n.nx, n.ny, n.nz, n.nx * (near.x - n.x) + n.ny * (near.y - n.y) + n.nz * (near.z - n.z) AS d FROM near JOIN n ON n.point_id = dst)
SELECT round(sum(nx * nx), 3) AS h00, round(sum(nx * (y * nz - z * ny)), 3) AS h03, round(sum((x * ny - y * nx) * (x * ny - y * nx)), 3) AS h55, round(sum(nx * d), 3) AS b0, round(sum((z * nx - x * nz) * d), 3) AS b4, round(sum(d * d), 3) AS error, count(*) AS n FROM e""")
def plane_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the linear system of one point-to-plane round."""
    source, target = _shifted(spark, sf_dir)
    pairs = register.correspondences(source, normals.with_normals(target, 10), 1.0)
    return rounded(pairs.agg(*register.linearized(pairs, "plane", register.Settings())).select("h00", "h03", "h55", "b0", "b4", "error", "n"), 3)


def weighted_sql(pairs: str) -> str:
    """The system's parts for pairs (x, y, z, qx, qy, qz, wxx..wzz: summed covariances), by the inverse of the 3-by-3."""
    det = "(wxx * (wyy * wzz - wyz * wyz) - wxy * (wxy * wzz - wyz * wxz) + wxz * (wxy * wyz - wyy * wxz))"
    inv = {"xx": "wyy * wzz - wyz * wyz", "xy": "wxz * wyz - wxy * wzz", "xz": "wxy * wyz - wxz * wyy", "yy": "wxx * wzz - wxz * wxz", "yz": "wxy * wxz - wxx * wyz", "zz": "wxx * wyy - wxy * wxy"}
    s = f"SELECT *, x - qx AS rx, y - qy AS ry, z - qz AS rz, {', '.join(f'({e}) / {det} AS i{n}' for n, e in inv.items())} FROM ({pairs})"
    return f"SELECT round(sum(ixx), 3) AS h00, round(sum(ixy), 3) AS h01, round(sum(ixx * rx + ixy * ry + ixz * rz), 3) AS b0, round(sum(rx * (ixx * rx + ixy * ry + ixz * rz) + ry * (ixy * rx + iyy * ry + iyz * rz) + rz * (ixz * rx + iyz * ry + izz * rz)), 3) AS error, count(*) AS n FROM ({s})"


SUMS = ", ".join(f"a.c{p} + b.c{p} AS w{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
COVERED = f"SELECT *, {PLANE_LIKE} FROM ({normals_sql((0.0, 0.0, 0.0))})"


@query("gicp_step", f"{CLOSE_SQL}, n AS MATERIALIZED ({COVERED}) {weighted_sql(f'SELECT near.x, near.y, near.z, b.x AS qx, b.y AS qy, b.z AS qz, {SUMS} FROM near JOIN n a ON a.point_id = near.point_id JOIN n b ON b.point_id = dst')}")
def gicp_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the linear system of one generalised round: residuals weigh by the inverse of both covariances' sum."""
    source, target = (normals.with_normals(c, 10, covariances=True) for c in _shifted(spark, sf_dir))
    pairs = register.correspondences(source, target, 1.0)
    return rounded(pairs.agg(*register.linearized(pairs, "gicp", register.Settings())).select("h00", "h01", "b0", "error", "n"), 3)


VOXEL2 = ", ".join(f"CAST(floor({c} * (1.0 / 2.0)) AS BIGINT) AS v{c}" for c in "xyz")
FLATTENED = ", ".join(f"{1.0 if a == b else 0.0} - CASE WHEN n >= 3 THEN 0.999 * a{a} * a{b} ELSE 0.0 END AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
VOXELS_SQL = f"SELECT vx, vy, vz, mx, my, mz, n, {FLATTENED} FROM ({eigen_sql(f'SELECT vx, vy, vz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {cov_sql(chr(120), chr(121), chr(122))} FROM (SELECT *, {VOXEL2} FROM v) GROUP BY vx, vy, vz')})"


@query("voxel_regularized", f"WITH v AS ({VECTORS_SQL}) SELECT vx, vy, vz, n, {', '.join(f'round(c{p}, 4) AS c{p}' for p in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM ({VOXELS_SQL}) WHERE n <> 3")
def voxel_regularized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane-like covariances by voxel. Voxels of three points are left out: their covariance has rank two at most, and its
    flattest direction is found to no more than half of a double's digits."""
    return rounded(register.regularized_voxels(views.vectors(spark, sf_dir), 2.0).where("n <> 3").select("vx", "vy", "vz", "n", "cxx", "cxy", "cxz", "cyy", "cyz", "czz"), 4)


@query("vgicp_step", f"{NEAR_SQL}, s AS (SELECT point_id, x + 0.05 AS x, y - 0.02 AS y, z AS z FROM v), n AS MATERIALIZED ({COVERED}), b AS MATERIALIZED ({VOXELS_SQL}) {weighted_sql(f'SELECT p.x, p.y, p.z, b.mx AS qx, b.my AS qy, b.mz AS qz, {SUMS} FROM (SELECT *, {VOXEL2} FROM s) p JOIN n a ON a.point_id = p.point_id JOIN b ON b.vx = p.vx AND b.vy = p.vy AND b.vz = p.vz')}")
def vgicp_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the linear system of one voxelised round."""
    source, target = _shifted(spark, sf_dir)
    source = normals.with_normals(target, 10, covariances=True).withColumns({"x": F.col("x") + 0.05, "y": F.col("y") - 0.02})
    pairs = register.voxel_correspondences(source, register.regularized_voxels(target, 2.0), 2.0)
    return rounded(pairs.agg(*register.linearized(pairs, "vgicp", register.Settings())).select("h00", "h01", "b0", "error", "n"), 3)


# --- streams ----------------------------------------------------------------------------------------------------------


def _stream_mapper() -> Mapper:
    return Mapper(Mapping(mode="global", sensor=Constant(0.03), point_filter=PointFilter(0.1, 0.9, 0.5, 20.0), length_x=50.0, length_y=50.0, resolution=0.5))


KALMAN_COLUMNS = ("row", "col", "elevation", "n_points", "variance", "lower_bound", "upper_bound")


@query("stream_map", KALMAN_MAP_SQL)
def stream_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans arrive five at a time as files; each time a new process goes on with the map."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    arrived = views.points(spark, sf_dir)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrived.schema)
    for first in range(0, 20, 5):
        arrived.where(F.col("scan_id").between(first, first + 4)).write.mode("append").parquet(f"{folder}/in")
        mapper = StreamingMapper(spark, _stream_mapper(), f"{folder}/map")
        mapper.start(scans(spark, f"{folder}/in", schema, max_files=1 << 20), f"{folder}/offsets").awaitTermination()
    return rounded(mapper.layers().select(*KALMAN_COLUMNS))


@query("stream_replay", KALMAN_MAP_SQL)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that come twice, before and after a restart, count once; deltas are folded into new bases on the way."""
    arrived, folder = views.points(spark, sf_dir), f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    for k in range(5):
        mapper = StreamingMapper(spark, _stream_mapper(), folder, compact_every=2)
        for batch in (k - 1, k, k):
            if batch >= 0:
                mapper.integrate(arrived.where(F.col("scan_id").between(4 * batch, 4 * batch + 3)), batch)
    return rounded(mapper.layers().select(*KALMAN_COLUMNS))


@query("stream_local", LOCAL_SQL)
def stream_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local map, four scans a batch: cells that the window leaves are lost, across batches as within them."""
    arrived = timed_scans(spark, sf_dir)
    mapper = StreamingMapper(spark, scan_mapper(spark, "local"), f"{shared_dir(spark)}/local-{uuid.uuid4().hex}", lateness=5.0, compact_every=3)
    for k in range(5):
        mapper.integrate(arrived.where(F.col("scan_id").between(4 * k, 4 * k + 3)), k)
    return rounded(mapper.layers().select(*MAP_LAYERS))


# --- angles, poses, deskewing -----------------------------------------------------------------------------------------


@query("normalized_angles", f"SELECT point_id, round(x - 2 * pi() * floor((x + pi()) / (2 * pi())), 6) AS angle, round(degrees(y), 6) AS deg, round(radians(x), 6) AS rad FROM ({POINTS_SQL})")
def normalized_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.points(spark, sf_dir).select("point_id", normalized_angle(F.col("x")).alias("angle"), F.degrees("y").alias("deg"), F.radians("x").alias("rad")))


@query("slerp_turns", f"SELECT point_id, round(sin((0.2 + t * (0.2 + intensity)) / 2), 6) AS qz, round(cos((0.2 + t * (0.2 + intensity)) / 2), 6) AS qw FROM ({POINTS_SQL})")
def slerp_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between turns about z by 0.2 and by 0.4 + intensity, the latter given by the opposite quaternion."""
    a, b = F.lit(0.1), F.lit(0.2) + F.col("intensity") / 2
    q = slerped([F.lit(0.0), F.lit(0.0), F.sin(a), F.cos(a)], [F.lit(0.0), F.lit(0.0), -F.sin(b), -F.cos(b)], F.col("t"))
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    return rounded(views.points(spark, sf_dir).select("point_id", (q[2] * sign).alias("qz"), (q[3] * sign).alias("qw")))


@query("extrinsic_lookup", f"SELECT point_id, round(x + CASE WHEN ring % 3 = 0 THEN 1.0 ELSE -2.0 END, 6) AS x, round(y, 6) AS y, round(z + CASE WHEN ring % 3 = 0 THEN 0.5 ELSE 0.25 END, 6) AS z FROM ({POINTS_SQL}) WHERE ring % 3 < 2")
def extrinsic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two known frames in the base's, those of an unknown one left out."""
    extrinsics = spark.createDataFrame([("f0", 1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0), ("f1", -2.0, 0.0, 0.25, 0.0, 0.0, 0.0, 1.0)], "frame_id string, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    p = views.points(spark, sf_dir).withColumn("frame_id", F.concat(F.lit("f"), (F.col("ring") % 3).cast("string")))
    return ids(asof.moved(asof.lookup(p, extrinsics)))


@query("pose_staleness", """WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS ts, value / 10 AS tx, user_id FROM events), p AS (SELECT ts, tx FROM e WHERE user_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1), q AS (SELECT event_id, ts FROM e WHERE user_id % 2 = 1),
 m AS (SELECT q.*, a.ts AS ats, a.tx AS atx FROM q ASOF LEFT JOIN p a ON q.ts >= a.ts), w AS (SELECT m.*, b.ts AS bts, b.tx AS btx FROM m ASOF LEFT JOIN p b ON m.ts <= b.ts)
SELECT event_id, round(CASE WHEN ats IS NULL THEN btx WHEN bts IS NULL OR bts <= ats THEN atx ELSE atx + (ts - ats) / (bts - ats) * (btx - atx) END, 4) AS tx FROM w WHERE least(abs(ts - coalesce(ats, bts)), abs(coalesce(bts, ats) - ts)) <= 60.0""")
def pose_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trajectory of all events of even users, asked at the times of the others: left out where no pose is within a minute."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000000 AS ts", "value / 10 AS tx", "user_id")
    poses = e.where("user_id % 2 = 0").groupBy("ts").agg(F.max_by("tx", "event_id").alias("tx")).withColumns({"ty": F.lit(0.0), "tz": F.lit(0.0)})
    asked = e.where("user_id % 2 = 1").select("event_id", "ts")
    return rounded(asof.poses_at(asked, poses, most_stale=60.0, columns=("tx", "ty", "tz")).select("event_id", "tx"), 4)


@query("deskew_trajectory", f"""WITH p AS ({POINTS_SQL}), a AS (SELECT *, max(t) OVER (PARTITION BY scan_id) AS e FROM p), w AS (SELECT *, x * cos(0.8 * t) - y * sin(0.8 * t) + 2 * t - 2 * e AS wx, x * sin(0.8 * t) + y * cos(0.8 * t) - t + e AS wy FROM a)
SELECT point_id, round(cos(0.8 * e) * wx + sin(0.8 * e) * wy, 6) AS x, round(-sin(0.8 * e) * wx + cos(0.8 * e) * wy, 6) AS y, round(z, 6) AS z FROM w""")
def deskew_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A steady turn and drift, given by poses every quarter of a second."""
    t = F.col("id") * 0.25
    poses = spark.range(9).select(t.alias("ts"), (2 * t).alias("tx"), (-t).alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(0.4 * t).alias("qz"), F.cos(0.4 * t).alias("qw"))
    return ids(asof.deskewed_along(views.points(spark, sf_dir).select("point_id", "scan_id", "x", "y", "z", "t"), poses))


@query("deskew_index", f"""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY scan_id ORDER BY point_id) - 1) / (count(*) OVER (PARTITION BY scan_id) - 1) AS a FROM ({POINTS_SQL})), w AS (SELECT *, x * cos(0.6 * a) - y * sin(0.6 * a) + 2 * a - 2 AS wx, x * sin(0.6 * a) + y * cos(0.6 * a) AS wy FROM p)
SELECT point_id, round(cos(0.6) * wx + sin(0.6) * wy, 6) AS x, round(-sin(0.6) * wx + cos(0.6) * wy, 6) AS y, round(z, 6) AS z FROM w""")
def deskew_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in order of their numbers, with a turn as well as a way."""
    still = [F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    end = [F.lit(v) for v in (2.0, 0.0, 0.0, 0.0, 0.0, float(np.sin(0.3)), float(np.cos(0.3)))]
    return ids(asof.deskewed(views.points(spark, sf_dir).select("point_id", "scan_id", "x", "y", "z"), still, end, "index"))


@query("nearest_bounded", f"{PAIRS_SQL} SELECT src_id, CAST(k AS INT) AS rank, dst_id, round(dist_sq, 6) AS dist_sq FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY dist_sq, dst_id) AS k FROM p WHERE src_id <> dst_id) WHERE k = 1 AND dist_sq <= 0.36")
def nearest_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other point, where it is no farther than 0.6."""
    v = views.vectors(spark, sf_dir)
    return rounded(spatial.nearest(v, v, 1, own=False, max_distance=0.6))


# --- files, messages, colours -----------------------------------------------------------------------------------------


@query("nuscenes_round_trip", f"SELECT scan_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(intensity, 4) AS intensity, ring FROM (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id) - 1 AS point_id, x, y, z, intensity, ring FROM ({POINTS_SQL}))")
def nuscenes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = clouds.decoded_bin(_files_of(spark, sf_dir, "bin", "intensity", "ring", ring=True), fields=5, ring=4)
    return rounded(back.select(F.col("file").cast("int").alias("scan_id"), "point_id", "x", "y", "z", "intensity", "ring"), 4)


@query("pcd_metadata", f"SELECT scan_id, count(*) AS width, CAST(1 AS BIGINT) AS height, CAST(1.0 AS DOUBLE) AS qw FROM ({POINTS_SQL}) GROUP BY scan_id")
def pcd_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = clouds.pcd_metadata(_files_of(spark, sf_dir, "pcd"))
    return heads.select(F.col("file").cast("int").alias("scan_id"), "width", "height", F.col("viewpoint")[3].alias("qw"))


@query("pcd_ascii_round_trip", f"SELECT scan_id, point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(intensity, 4) AS intensity, color FROM ({NUMBERED_SQL})")
def pcd_ascii_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = clouds.decoded_pcd(_files_of(spark, sf_dir, "pcd", "intensity", "color", binary=False, precision=9))
    return rounded(back.select(F.col("file").cast("int").alias("scan_id"), "point_id", "x", "y", "z", "intensity", "color"), 4)


@query("kitti_poses", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS DOUBLE) AS ts, round(value / 10, 4) AS tx, round(sin(value / 1000), 4) AS qz, round(cos(value / 1000), 4) AS qw FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT ts) = count(*))")
def kitti_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's trajectory in a file of matrices, numbered again when read; users with two events at once have no one order."""
    path = f"{shared_dir(spark)}/kitti-{uuid.uuid4().hex}"
    t = views.trajectory(spark, sf_dir)
    clear = t.groupBy("user_id").agg((F.count_distinct("ts") == F.count(F.lit(1))).alias("ok")).where("ok").select("user_id")
    trajectories.write_kitti(t.join(clear, "user_id"), path, by="user_id")
    back = trajectories.read_kitti(spark, path)
    return rounded(back.select(F.regexp_extract("file", "user_id=([0-9]+)", 1).cast("long").alias("user_id"), "ts", "tx", "qz", "qw"), 4)


@query("npz_round_trip", f'SELECT "row", "col", round(elevation, 4) AS elevation, round(variance, 4) AS variance FROM ({MAP_SQL})')
def npz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map in nine tiles, written, read and put together again."""
    path = f"{shared_dir(spark)}/npz-{uuid.uuid4().hex}"
    maps.save_npz(path, terrain(spark, sf_dir).select("row", "col", "elevation", "variance"), GRID, tile=40)
    return rounded(maps.load_npz(spark, path)[0].select("row", "col", "elevation", "variance"), 4)


@query("message_round_trip", f"SELECT CAST(scan_id AS INT) AS scan_id, point_id, round(x, 4) AS x, round(z, 4) AS z, round(intensity, 4) AS intensity, ring, round(t, 4) AS t, color FROM (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id) - 1 AS point_id, x, z, intensity, ring, t, color FROM ({POINTS_SQL}))")
def message_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan as a cloud message and back."""
    back = messages.decoded(messages.encoded(views.points(spark, sf_dir), piece=PIECE))
    return rounded(back.select("scan_id", "point_id", "x", "z", "intensity", "ring", "t", "color"), 4)


@query("map_message_region", f'SELECT row_number() OVER (ORDER BY "col", "row") - 1 AS point_id, round(24.75 - "row" * 0.5, 4) AS x, round(24.75 - "col" * 0.5, 4) AS y, round(elevation, 4) AS z, color FROM ({MAP_SQL}) WHERE "row" BETWEEN 20 AND 69 AND "col" BETWEEN 30 AND 59')
def map_message_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the map as one cloud message, read again."""
    sent = messages.map_message(terrain(spark, sf_dir), GRID, (20, 30, 50, 30))
    return rounded(messages.decoded(sent.withColumn("scan_id", F.lit(0))).select("point_id", "x", "y", "z", "color"), 4)


@query("grid_message", f"""SELECT layer, 100 AS rows, 100 AS cols, CAST(50.0 AS DOUBLE) AS length_x, layer = 'elevation' AS basic, 40000 AS bytes FROM (SELECT unnest(['elevation', 'variance']) AS layer) WHERE (SELECT count(*) FROM ({MAP_SQL})) > 0""")
def grid_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = messages.grid_message(terrain(spark, sf_dir).select("row", "col", "elevation", "variance"), GRID)
    return sent.select("layer", "rows", "cols", "length_x", "basic", F.octet_length("data").alias("bytes"))


@query("map_boundary", "SELECT CAST(i AS INT) AS nth, CAST(CASE WHEN i IN (0, 1, 4) THEN 25 ELSE -25 END AS DOUBLE) AS x, CAST(CASE WHEN i IN (0, 3, 4) THEN 25 ELSE -25 END AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM range(5) t(i)")
def map_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.boundary(spark, GRID)


MARK = "greatest(0.0, least(1.0, slope / 45.0))"


@query("normal_lines", f"""SELECT "row", "col", round(24.75 - "row" * 0.5, 3) AS x, round(24.75 - "row" * 0.5 + 0.15 * nx, 3) AS x1, round({MARK}, 3) AS r, round(0.8 * (1 - {MARK}), 3) AS g FROM ({features_sql(f'SELECT "row", "col", elevation AS v FROM ({MAP_SQL})')}) WHERE "row" % 2 = 0 AND "col" % 2 = 0""")
def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import terrain_features

    cells = terrain(spark, sf_dir).select("row", "col", "elevation").join(terrain_features(spark, sf_dir), ["row", "col"])
    return rounded(messages.normal_markers(cells, GRID, 2).select("row", "col", "x", "x1", "r", "g"), 3)


PICKED_SQL = f"WITH m AS ({MAP_SQL}), s AS (SELECT list_sort(list(elevation)) AS a, count(*) AS n FROM m), e AS (SELECT a[1 + CAST(floor(n * 0.01) AS INT)] AS lo, a[1 + least(CAST(floor(n * 0.99) AS INT), n - 1)] AS hi FROM s), t AS (SELECT \"row\", \"col\", greatest(0.0, least(1.0, (elevation - lo) / CASE WHEN hi - lo >= 1e-6 THEN hi - lo ELSE 1 END)) AS t FROM m, e)"
JET_SQL = ("CASE WHEN t < 0.5 THEN 0.0 WHEN t < 0.75 THEN 4 * (t - 0.5) ELSE 1.0 END", "CASE WHEN t < 0.25 THEN 4 * t WHEN t < 0.75 THEN 1.0 ELSE 1 - 4 * (t - 0.75) END", "CASE WHEN t < 0.25 THEN 1.0 WHEN t < 0.5 THEN 1 - 4 * (t - 0.25) ELSE 0.0 END")
STOPS_SQL = ["[" + ", ".join(repr(s[k]) for s in maps.VIRIDIS) + "]" for k in range(3)]
VIRIDIS_SQL = [f"{s}[1 + CAST(floor(t * 7) AS INT)] * (1 - (t * 7 - floor(t * 7))) + {s}[1 + least(CAST(floor(t * 7) AS INT) + 1, 7)] * (t * 7 - floor(t * 7))" for s in STOPS_SQL]
for scale, parts in (("jet", JET_SQL), ("viridis", VIRIDIS_SQL)):
    sql = f'{PICKED_SQL} SELECT "row", "col", {", ".join(f"CAST(floor(({e}) * 255 + 0.5) AS INT) AS {c}" for c, e in zip("rgb", parts, strict=True))}, 255 AS a FROM t'
    query(f"png_{scale}", sql)(lambda s, d, m=scale: maps.shaded(terrain(s, d), "elevation", colormap=m))


def horner(c: tuple[float, ...]) -> str:
    out = repr(c[-1])
    for v in reversed(c[:-1]):
        out = f"({v!r} + t * {out})"
    return f"greatest(0.0, least(1.0, {out}))"


def view_sql(by: str, parts: list[str] | tuple[str, ...], low: str = "min(v)") -> str:
    return f"WITH p AS (SELECT point_id, CAST({by} AS DOUBLE) AS v FROM ({POINTS_SQL})), b AS (SELECT {low} AS lo, max(v) AS hi FROM p), t AS (SELECT point_id, greatest(0.0, least(1.0, (v - lo) / CASE WHEN hi - lo > 1e-6 THEN hi - lo ELSE 1.0 END)) AS t FROM p, b) SELECT point_id, {', '.join(f'CAST(floor(({e}) * 255) AS INT) AS {c}' for c, e in zip('rgb', parts, strict=True))} FROM t"


for name, by, sql_by, scale, parts in (
    ("intensity_turbo", "intensity", "intensity", "turbo", [horner(c) for c in maps.TURBO]), ("range_viridis", "range", "sqrt(x * x + y * y + z * z)", "viridis", [horner(c) for c in maps.SOFT_VIRIDIS]),
    ("height_jet", "z", "z", "jet", JET_SQL), ("ring_gray", "ring", "ring", "grayscale", ["t"] * 3),
):
    query(f"color_{name}", view_sql(sql_by, parts, "0.0" if by == "ring" else "min(v)"))(lambda s, d, b=by, m=scale: maps.colored(views.points(s, d), b, m).select("point_id", "r", "g", "b"))


@query("color_ground", ORACLES["segment_ground"].replace("SELECT point_id, n >= 2", "SELECT point_id, CASE WHEN ground THEN 139 END AS r, CASE WHEN ground THEN 90 END AS g, CASE WHEN ground THEN 43 END AS b FROM (SELECT point_id, n >= 2") + ")")
def color_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.segment import segment_ground

    return maps.flagged(segment_ground(views.points(spark, sf_dir)), "ground", maps.GROUND, None).select("point_id", "r", "g", "b")


@query("rasterized_points", f'SELECT {FACT_COLUMNS.replace("round(min_z, 6) AS min_z", "round(min_z, 6) AS z")} FROM ({FACTS_SQL})')
def rasterized_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observer of rasterised scans gets: a point at each cell's lowest height."""
    got: list[DataFrame] = []
    mapper = Mapper(Mapping(mode="global", sensor=Constant(0.03), point_filter=PointFilter(0.1, 0.9, 0.5, 20.0), length_x=50.0, length_y=50.0, resolution=0.5), on_rasterized=got.append)
    mapper.facts(mapper.preprocessed(views.points(spark, sf_dir)))
    return rounded(got[0].drop("min_z_var").withColumnRenamed("min_z", "z"))


@query("kalman_noise", f"""WITH f AS ({FACTS_SQL}), k AS (SELECT "row", "col", list_reduce(list_sort(list({{'s': scan_id, 'z': min_z, 'r': CASE WHEN n = 1 THEN 0.01 ELSE n * 1e-4 END}})), lambda a, e: CASE WHEN a.n = 0 THEN {{'x': e.z, 'p': e.r, 'n': 1}} ELSE {{'x': a.x + (a.p + 5e-4) / (a.p + 5e-4 + e.r) * (e.z - a.x), 'p': least(greatest((1 - (a.p + 5e-4) / (a.p + 5e-4 + e.r)) * (a.p + 5e-4), 2e-4), 1e-2), 'n': a.n + 1}} END, {{'x': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'n': 0}}) AS s FROM f GROUP BY ALL)
SELECT "row", "col", round(s.x, 6) AS elevation, round(s.p, 6) AS p FROM k""")
def kalman_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances that differ, some missing, with process noise and both clamps."""
    f = raster.rasterized(views.seen(spark, sf_dir), GRID)
    cells = f.select("scan_id", "row", "col", F.col("min_z").alias("z"), F.when(F.col("n") == 1, F.lit(None)).otherwise(F.col("n") * 1e-4).alias("variance"))
    s = estimate.fold(cells, estimate.Kalman(2e-4, 1e-2, 5e-4))
    return rounded(s.select("row", "col", F.col("state.x").alias("elevation"), F.col("state.p").alias("p")))


@query("moved_back", f"SELECT point_id, {XYZ_SQL} FROM ({POINTS_SQL})")
def moved_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By motions from angles, from a quaternion and in the plane, and back again by their inverses."""
    p = views.points(spark, sf_dir).select("point_id", "x", "y", "z")
    motions = (Rigid.from_rpy(0.3, -0.2, 1.1, (1, 2, 3)), Rigid.from_quaternion((0.1, 0.2, -0.3, 0.9), (4, 5, 6)), Rigid.from_2d(1.0, -2.0, 0.7))
    for m in motions:
        p = transformed(p, m)
    for m in reversed(motions):
        p = transformed(p, m.inverse())
    return ids(p)


__all__ = ["twin"]
