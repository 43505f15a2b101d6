"""Per-cell recursive estimators as ordered folds over a cell's observations.

A fold sorts the cell's observations by scan and walks them with a state. The array is as long as the cell was seen;
`in_slices` folds long histories range of scans after range, each from the states of the one before, so that no array
holds more than one range. A fold can start from stored states as well (see streaming.mapper).

The state of a cell also holds what else a map knows of it, if the observations have it: bounds of heights, the highest
point of the last scan, brightest intensity and last colour. A cell that is cleared or that the window has left loses
all of it at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.tables import stored
from .raster import CELL

CORE = {"x": "double", "p": "double", "n": "bigint", "mean": "double", "m2": "double", "logodds": "double", "ghost": "double"}
#: Kept as well where observations have the column high, intensity or color.
MORE = {"lo": "double", "hi": "double", "obstacle": "double", "at": "bigint", "intensity": "double", "color": "int"}
#: Columns of observations that MORE comes from.
EXTRAS = ("high", "intensity", "color")


def state_type(more: bool) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in (CORE | (MORE if more else {})).items()) + ">"


STATE = state_type(False)


@dataclass(frozen=True)
class Kalman:
    min_variance: float = 1e-4
    max_variance: float = 1e-2
    process_noise: float = 0.0


@dataclass(frozen=True)
class Visibility:
    """Evidence against ghosts: a cell whose height rays pass below loses log-odds, one with points gains."""

    threshold: float = 0.05
    observed: float = 0.4
    ghost: float = 0.2
    most: float = 2.0
    clear: float = -1.0


def blank(ghost: Column | None = None, more: bool = False) -> Column:
    null = F.lit(None)
    values = {"n": F.lit(0), "mean": F.lit(0.0), "m2": F.lit(0.0), "logodds": F.lit(0.0), "ghost": null if ghost is None else ghost}
    return F.struct(*[values.get(n, null).alias(n) for n in (CORE | (MORE if more else {}))]).cast(state_type(more))


def measured(s: Column, z: Column, variance: Column, k: Kalman, e: Column | None = None, extras: tuple[str, ...] = (), at: Column | None = None) -> Column:
    """The state after one height measurement; a variance that is missing or not positive counts as the largest. extras: which
    of EXTRAS the observation e has; at: the number of its scan."""
    r = F.when(variance > 0, variance).otherwise(F.lit(k.max_variance))
    prior = s["p"] + k.process_noise
    gain = prior / (prior + r)
    first = s["n"] == 0
    n = s["n"] + 1
    mean = s["mean"] + (z - s["mean"]) / n
    parts = {
        "x": F.when(first, z).otherwise(s["x"] + gain * (z - s["x"])),
        "p": F.when(first, r).otherwise(F.least(F.greatest((1 - gain) * prior, F.lit(k.min_variance)), F.lit(k.max_variance))),
        "n": n,
        "mean": mean,
        "m2": s["m2"] + (z - s["mean"]) * (z - mean),
        "logodds": s["logodds"],
        "ghost": s["ghost"],
    }
    if extras:
        high = e["high"] if "high" in extras else z
        parts |= {"lo": F.least(s["lo"], z), "hi": F.greatest(s["hi"], high), "obstacle": F.when(high > z, high), "at": F.lit(None) if at is None else at}
        parts["intensity"] = F.greatest(s["intensity"], e["intensity"]) if "intensity" in extras else F.lit(None)
        parts["color"] = F.coalesce(e["color"], s["color"]) if "color" in extras else F.lit(None)
    return F.when(z.isNull() | F.isnan(z), s).otherwise(F.struct(*[v.alias(name) for name, v in parts.items()]).cast(state_type(bool(extras))))


def seen(s: Column, hits: Column, ray: Column, v: Visibility, more: bool = False) -> Column:
    """Evidence of one scan: points in the cell first, then the lowest ray over it against the height just updated."""
    gained = F.least(s["logodds"] + F.coalesce(hits, F.lit(0)) * v.observed, F.greatest(F.lit(v.most), s["logodds"]))
    conflict = ray.isNotNull() & s["x"].isNotNull() & (s["x"] > ray + v.threshold)
    odds = F.when(conflict, gained - v.ghost).otherwise(gained)
    return F.when(conflict & (odds < v.clear), blank(F.lit(1.0), more)).otherwise(s.withField("logodds", odds))


def fold(cells: DataFrame, kalman: Kalman = Kalman(), visibility: Visibility | None = None, order: str = "scan_id", start: str | None = None) -> DataFrame:
    """cells (row, col, order, z, variance[, hits, ray, reset, high, intensity, color]) as row, col, state.

    reset: true where the moving window has left the cell since its last observation. start: a column with the state
    to go on from, the same in all rows of a cell.
    """
    extras = tuple(c for c in EXTRAS if c in cells.columns)
    names = [c for c in ("z", "variance", "hits", "ray", "reset", *extras) if c in cells.columns]
    numbered = cells.schema[order].dataType.simpleString() in ("int", "bigint")

    def step(s: Column, e: Column) -> Column:
        if "reset" in names:
            s = F.when(F.coalesce(e["reset"], F.lit(False)), blank(more=bool(extras))).otherwise(s)
        s = measured(s, e["z"], e["variance"], kalman, e, extras, e[order].cast("long") if numbered else None)
        if visibility is not None:
            s = F.transform(F.array(s), lambda one: seen(one, e["hits"], e["ray"], visibility, bool(extras)))[0]
        return s

    aggregates = [F.sort_array(F.collect_list(F.struct(order, *names))).alias("events")]
    if start:
        aggregates.append(F.first(start, ignorenulls=True).alias("start"))
    grouped = cells.groupBy(*CELL).agg(*aggregates)
    begin = F.coalesce(F.col("start"), blank(more=bool(extras))) if start else blank(more=bool(extras))
    return grouped.select(*CELL, F.aggregate("events", begin, step).alias("state"))


def carried(cells: DataFrame, states: DataFrame | None, fold_: Callable[..., DataFrame]) -> DataFrame:
    """States after cells: those of cells seen now go on from states, the others stay."""
    if states is None:
        return fold_(cells)
    touched = fold_(cells.join(states, list(CELL), "left"), start="state")
    return touched.unionByName(states.join(cells.select(*CELL).distinct(), list(CELL), "left_anti"))


def in_slices(cells: DataFrame, fold_: Callable[..., DataFrame], most: int, order: str = "scan_id") -> DataFrame:
    """fold_ over ranges of at most `most` scans, one after another, each from the states before; in one where that is enough."""
    scans = cells.select(F.col(order).cast("long").alias("s")).distinct()
    if scans.count() <= most:
        return fold_(cells)
    place = F.row_number().over(Window.orderBy("s"))  # a row a scan
    ends = [r["s"] for r in scans.withColumn("k", place).where(F.col("k") % most == 0).select("s").orderBy("s").collect()]
    states, before = None, None
    for end in [*ends, None]:
        part = cells if before is None else cells.where(F.col(order) > before)
        part = part if end is None else part.where(F.col(order) <= end)
        states, before = stored(carried(part, states, fold_), "states"), end
    return states


def layers(states: DataFrame, sigmas: float = 2.0, last: int | None = None) -> DataFrame:
    """The public layers of cells that are measured now, or were cleared as ghosts. last: the number of the last scan, whose cells
    alone have an obstacle."""
    s = F.col("state")
    variance = F.when(s["n"] > 1, s["m2"] / (s["n"] - 1)).otherwise(F.lit(0.0))
    reach = sigmas * F.sqrt(F.greatest(variance, F.lit(0.0)))
    hit = s["x"].isNotNull()
    out = [s["x"].alias("elevation"), F.when(hit, variance).alias("variance"), F.when(hit, s["n"]).alias("n_points"), F.when(hit, s["x"] - reach).alias("lower_bound"), F.when(hit, s["x"] + reach).alias("upper_bound"), s["ghost"].alias("ghost_removal")]
    return states.where(hit | s["ghost"].isNotNull()).select(*CELL, *out, *more_layers(states, last))


def more_layers(states: DataFrame, last: int | None) -> list[Column]:
    s = F.col("state")
    if "lo" not in states.schema["state"].dataType.names:
        return []
    return [s["lo"].alias("elevation_min"), s["hi"].alias("elevation_max"), F.when(s["at"] == last, s["obstacle"]).alias("obstacle") if last is not None else s["obstacle"].alias("obstacle"), s["intensity"].alias("intensity"), s["color"].alias("color")]


# --- streaming quantiles --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class P2:
    """Five quantile markers moved by parabolic interpolation; elevation is that of `marker`; most > 0 fades old samples."""

    quantiles: tuple[float, float, float, float, float] = (0.01, 0.16, 0.50, 0.84, 0.99)
    marker: int = 3
    most: float = 0.0

    def __post_init__(self) -> None:
        if list(self.quantiles) != sorted(self.quantiles):
            raise ValueError("quantile markers must ascend")


@dataclass
class Markers:
    """P2 states of many cells: positions q and numbers n of the five markers, samples (capped by fading) and all of them,
    log-odds, and whether a cell was cleared as a ghost (NaN: no)."""

    q: np.ndarray
    n: np.ndarray
    count: np.ndarray
    points: np.ndarray
    logodds: np.ndarray
    ghost: np.ndarray

    @classmethod
    def blank(cls, m: int) -> Markers:
        return cls(np.full((m, 5), np.nan), np.tile(np.arange(5.0), (m, 1)), np.zeros(m), np.zeros(m, dtype=np.int64), np.zeros(m), np.full(m, np.nan))

    def clear(self, rows: np.ndarray) -> None:
        fresh = Markers.blank(len(rows))
        for name in ("q", "n", "count", "points", "logodds", "ghost"):
            getattr(self, name)[rows] = getattr(fresh, name)

    def add(self, rows: np.ndarray, z: np.ndarray, p2: P2) -> None:
        """One more sample of each of rows."""
        self.points[rows] += 1
        few = self.count[rows] < 5
        new, old = rows[few], rows[~few]
        if len(new):
            self.q[new, self.count[new].astype(int)] = z[few]
            self.count[new] += 1
            whole = new[self.count[new] == 5]
            self.q[whole] = np.sort(self.q[whole], axis=1)
        if len(old):
            self._move(old, z[~few], p2)

    def _move(self, on: np.ndarray, z: np.ndarray, p2: P2) -> None:
        a, b, c = self.q[on], self.n[on], self.count[on]
        at = np.minimum((z[:, None] >= a[:, :4]).sum(1) - 1, 3).clip(0)
        a[:, 0], a[:, 4] = np.minimum(a[:, 0], z), np.maximum(a[:, 4], z)
        b += np.arange(5) > at[:, None]
        target = np.array(p2.quantiles) * c[:, None]
        c += 1
        if p2.most > 0:
            over = c > p2.most
            b[over] *= (p2.most / c[over])[:, None]
            c[over] = p2.most
        for i in (1, 2, 3):
            gap = target[:, i] - b[:, i]
            move = np.where((gap >= 1) & (b[:, i + 1] - b[:, i] > 1), 1, np.where((gap <= -1) & (b[:, i - 1] - b[:, i] < -1), -1, 0))
            up, down = b[:, i + 1] - b[:, i], b[:, i] - b[:, i - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                bent = a[:, i] + move / (up + down) * ((down + move) * (a[:, i + 1] - a[:, i]) / up + (up - move) * (a[:, i] - a[:, i - 1]) / down)
                rows = np.arange(len(on))
                side = i + move
                straight = a[:, i] + move * (a[rows, side] - a[:, i]) / (b[rows, side] - b[:, i])
            new = np.where((a[:, i - 1] < bent) & (bent < a[:, i + 1]), bent, np.where(np.isfinite(straight), straight, a[:, i]))
            a[:, i] = np.where(move != 0, new, a[:, i])
            b[:, i] += move
        self.q[on], self.n[on], self.count[on] = a, b, c

    def see(self, rows: np.ndarray, hits: np.ndarray, ray: np.ndarray, v: Visibility, marker: int) -> np.ndarray:
        """Evidence of one scan, after its measurement; which of rows were cleared."""
        height = self.q[rows, marker]
        odds = np.minimum(self.logodds[rows] + np.nan_to_num(hits) * v.observed, np.maximum(v.most, self.logodds[rows]))
        conflict = height > ray + v.threshold  # false where either is NaN
        odds = np.where(conflict, odds - v.ghost, odds)
        self.logodds[rows] = odds
        gone = rows[conflict & (odds < v.clear)]
        self.clear(gone)
        self.ghost[gone] = 1.0
        return gone


def p2_markers(lists: list[np.ndarray], p2: P2) -> np.ndarray:
    """The five markers after each list's values in turn (NaN where not reached)."""
    m = Markers.blank(len(lists))
    for rows, values in by_length([len(x) for x in lists]):
        for k in range(values):
            on = np.array([i for i in rows if len(lists[i]) > k])
            m.add(on, np.array([lists[i][k] for i in on]), p2)
    return m.q


def by_length(sizes: list[int], room: int = 1 << 22) -> Iterator[tuple[list[int], int]]:
    """Rows of about one length together, and that length: rows times length is at most room, or one row."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    while order:
        longest = max(1, sizes[order[0]])
        some = [i for i in order[: max(1, room // longest)] if 2 * sizes[i] >= longest or i == order[0]]
        yield some, sizes[some[0]]
        order = order[len(some) :]


P2_STATE = "struct<q:array<double>,n:array<double>,count:double,points:bigint,logodds:double,ghost:double,lo:double,hi:double,obstacle:double,at:bigint,intensity:double,color:int>"


def p2_states(cells: DataFrame, p2: P2 = P2(), visibility: Visibility | None = None, order: tuple[str, ...] = ("scan_id",), by: tuple[str, ...] = CELL, value: str = "z", start: str | None = None) -> DataFrame:
    """by, state (P2_STATE): markers and, as fold has them, log-odds, resets and what else is known of a cell. All cells of a batch
    advance together, those of about one length at a time, so that one long history pads no others."""
    names = [c for c in ("hits", "ray", "reset", *EXTRAS) if c in cells.columns]
    at = F.col(order[0]).cast("long") if cells.schema[order[0]].dataType.simpleString() in ("int", "bigint") else F.lit(None).cast("long")
    columns = [F.col(value).cast("double").alias("z"), at.alias("at"), *[F.col(c).cast("double").alias(c) for c in names]]
    event = F.struct(*order, F.struct(*columns).alias("e"))
    begin = F.first(start, ignorenulls=True) if start else F.lit(None).cast(P2_STATE)
    lists = cells.groupBy(*by).agg(F.sort_array(F.collect_list(event)).alias("__e"), begin.alias("__start"))
    part = lambda c: F.transform("__e", lambda x: x["e"][c]).alias(f"__{c}")
    flat = [part(c) for c in ("z", "at", *names)]
    lists = lists.select(*by, "__start", *flat)
    width = len(by)
    schema = lists.select(*by, F.lit(None).cast(P2_STATE).alias("state")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = {c: [np.array(v.as_py(), dtype=float) for v in batch.column(width + 1 + i)] for i, c in enumerate(("z", "at", *names))}
            started = [v.as_py() for v in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(p2_walk(events, started, p2, visibility), type=arrow_type)], names=[*by, "state"])

    arrow_type = pa.struct([("q", pa.list_(pa.float64())), ("n", pa.list_(pa.float64())), ("count", pa.float64()), ("points", pa.int64()), ("logodds", pa.float64()), ("ghost", pa.float64()), *[(c, pa.float64()) for c in ("lo", "hi", "obstacle")], ("at", pa.int64()), ("intensity", pa.float64()), ("color", pa.int32())])
    return lists.mapInArrow(run, schema)


def p2_walk(events: dict[str, list[np.ndarray]], started: list[dict | None], p2: P2, visibility: Visibility | None) -> list[dict]:
    """The state of each cell after its events."""
    size = [len(x) for x in events["z"]]
    m, more = Markers.blank(len(size)), {c: np.full(len(size), np.nan) for c in ("lo", "hi", "obstacle", "at", "intensity", "color")}
    for i, s in enumerate(started):
        if s is not None:
            m.q[i], m.n[i] = [np.nan if v is None else v for v in s["q"]], s["n"]
            m.count[i], m.points[i], m.logodds[i], m.ghost[i] = s["count"], s["points"], s["logodds"], np.nan if s["ghost"] is None else s["ghost"]
            for c, v in more.items():
                v[i] = np.nan if s[c] is None else s[c]
    for rows, longest in by_length(size):
        padded = {c: np.full((len(rows), longest), np.nan) for c in events}
        for c, v in padded.items():
            for j, i in enumerate(rows):
                v[j, : size[i]] = events[c][i]
        on_all, own = np.array(rows, dtype=int), np.array([size[i] for i in rows])
        for k in range(longest):
            live = own > k
            on = on_all[live]
            e = {c: v[live, k] for c, v in padded.items()}
            if "reset" in e:
                gone = on[e["reset"] == 1]
                m.clear(gone)
                for v in more.values():
                    v[gone] = np.nan
            hit = ~np.isnan(e["z"])
            at, z = on[hit], e["z"][hit]
            m.add(at, z, p2)
            high = np.fmax(e["high"][hit], z) if "high" in e else z
            more["lo"][at], more["hi"][at] = np.fmin(more["lo"][at], z), np.fmax(more["hi"][at], high)
            more["obstacle"][at], more["at"][at] = np.where(high > z, high, np.nan), e["at"][hit]
            if "intensity" in e:
                more["intensity"][at] = np.fmax(more["intensity"][at], e["intensity"][hit])
            if "color" in e:
                more["color"][at] = np.where(np.isnan(e["color"][hit]), more["color"][at], e["color"][hit])
            if visibility is not None:
                gone = m.see(on, e.get("hits", np.zeros(len(on))), e.get("ray", np.full(len(on), np.nan)), visibility, p2.marker)
                for v in more.values():
                    v[gone] = np.nan
    real = lambda v: None if np.isnan(v) else float(v)
    whole = lambda v: None if np.isnan(v) else int(v)
    return [
        {"q": list(map(real, m.q[i])), "n": m.n[i].tolist(), "count": float(m.count[i]), "points": int(m.points[i]), "logodds": float(m.logodds[i]), "ghost": real(m.ghost[i]), **{c: real(more[c][i]) for c in ("lo", "hi", "obstacle", "intensity")}, "at": whole(more["at"][i]), "color": whole(more["color"][i])}
        for i in range(len(size))
    ]


def p2_layers(states: DataFrame, p2: P2 = P2(), by: tuple[str, ...] = CELL, last: int | None = None) -> DataFrame:
    """by, elevation, variance, bounds and count, and more layers. Markers not reached are null: elevation from the fourth value on,
    if the marker is 3."""
    s = F.col("state")
    q = lambda k: F.get(s["q"], F.lit(k))
    out = [q(p2.marker).alias("elevation"), F.pow((q(3) - q(1)) / 2, F.lit(2)).alias("variance"), q(0).alias("lower_bound"), q(4).alias("upper_bound"), s["points"].alias("n_points")]
    kept = (s["points"] > 0) | s["ghost"].isNotNull()
    return states.where(kept).select(*by, *out, s["ghost"].alias("ghost_removal"), *more_layers(states, last))


def p2_fold(cells: DataFrame, p2: P2 = P2(), order: tuple[str, ...] = ("scan_id",), by: tuple[str, ...] = CELL, value: str = "z") -> DataFrame:
    """by, elevation, variance, bounds and count."""
    out = p2_layers(p2_states(cells, p2, order=order, by=by, value=value), p2, by)
    return out.select(*by, "elevation", "variance", "lower_bound", "upper_bound", "n_points")
