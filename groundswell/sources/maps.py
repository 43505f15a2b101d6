"""Map files: layered NPZ archives and PNG pictures.

An archive holds a rectangle of dense layers, so a map is written in tiles, an archive each with its own place; tiles
are built in their own tasks and sent to the store one after another. Archives are read side by side, as cells.
"""

from __future__ import annotations

import io
import json
import struct
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import Grid
from ..operators.raster import CELL
from ..plans.tables import stored
from .clouds import write_files

VERSION = 1
#: Eight stops of the viridis colour scale of pictures, as red, green, blue from 0 to 1. (fixed values)
VIRIDIS = ((0.267, 0.005, 0.329), (0.283, 0.141, 0.458), (0.254, 0.265, 0.530), (0.207, 0.372, 0.553), (0.164, 0.471, 0.558), (0.128, 0.567, 0.551), (0.267, 0.679, 0.481), (0.993, 0.906, 0.144))
#: Coefficients, lowest power first, of the polynomials in a viewer's colour scales: red, green, blue. (fixed values)
TURBO = ((0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943), (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604), (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973))
SOFT_VIRIDIS = ((0.267004, 0.003991, 1.091692, -0.356783), (0.004874, 1.421258, -0.514403, 0.088297), (0.329415, 0.283913, -1.413053, 0.800467))
#: Colours of a plane's points and the others, and of ground. (fixed values)
PLANE, OTHERS, GROUND = (0, 200, 0), (200, 200, 200), (139, 90, 43)


def archive(meta: dict, layers: dict[str, np.ndarray]) -> bytes:
    """Stored, not compressed: a JSON record named meta, and a float32 layer, columns first, for each name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, array in ({"meta": np.frombuffer(json.dumps(meta).encode(), dtype=np.uint8)} | {k: np.asfortranarray(v) for k, v in layers.items()}).items():
            buffer = io.BytesIO()
            np.lib.format.write_array(buffer, array, allow_pickle=False)
            z.writestr(f"{name}.npy", buffer.getvalue())
    return out.getvalue()


def opened(content: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """The record and the whole layers of an archive, rows and columns from the map's corner on. Newer versions, archives without
    record or without any whole layer raise."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        if "meta" not in z:
            raise ValueError("the archive has no meta record")
        raw = z["meta"]
        meta = json.loads(raw.tobytes().decode())
        if meta["version"] > VERSION:
            raise ValueError(f"version {meta['version']} is newer than {VERSION}")
        shape = tuple(meta["size"])
        layers = {}
        for name in z.files:
            if name == "meta":
                continue
            try:
                array = z[name]
            except (ValueError, zipfile.BadZipFile):
                warnings.warn(f"layer {name} is damaged", stacklevel=2)
                continue
            if array.dtype != np.float32 or array.shape != shape:
                warnings.warn(f"layer {name} has another shape or type", stacklevel=2)
                continue
            layers[name] = np.roll(array, [-v for v in meta.get("start_index", [0, 0])], axis=(0, 1))
    if not layers:
        raise ValueError("the archive has no layer")
    return meta, layers


def encoded_npz(cells: DataFrame, grid: Grid, layers: list[str] | None = None, frame_id: str = "map", tile: int = 1024) -> DataFrame:
    """path, content: an archive for each tile of the map that has cells. Unknown layers are skipped."""
    names = layers or [c for c in cells.columns if c not in CELL and not c.startswith("_")]
    for n in [n for n in names if n not in cells.columns]:
        warnings.warn(f"no layer {n}", stacklevel=2)
    names = [n for n in names if n in cells.columns]
    rows = cells.where(grid.holds(F.col("row"), F.col("col"))).select(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), *CELL, *[F.col(n).cast("double").alias(n) for n in names])

    def build(key: tuple, part: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * tile, key[1].as_py() * tile
        shape = (min(tile, grid.rows - r0), min(tile, grid.cols - c0))
        at = part.column("row").to_numpy() - r0, part.column("col").to_numpy() - c0
        dense = {}
        for n in names:
            dense[n] = np.full(shape, np.nan, dtype=np.float32)
            dense[n][at] = part.column(n).to_numpy()
        place = [grid.top_x - (r0 + shape[0] / 2) * grid.resolution, grid.top_y - (c0 + shape[1] / 2) * grid.resolution]
        meta = {"version": VERSION, "resolution": grid.resolution, "position": place, "size": list(shape), "frame_id": frame_id, "start_index": [0, 0]}
        return pa.table({"path": [f"tile-{r0 // tile}-{c0 // tile}.npz"], "content": pa.array([archive(meta, dense)], type=pa.binary())})

    return rows.groupBy("tr", "tc").applyInArrow(build, "path string, content binary")


def decoded_npz(files: DataFrame, layers: list[str]) -> DataFrame:
    """Of archives (path, content): path, row, col, x, y (of the cell's centre), resolution, frame_id and the layers (null where one
    is not measured or not there), for each cell with any layer measured."""
    ddl = "path string, row long, col long, x double, y double, resolution double, frame_id string, " + ", ".join(f"`{n}` double" for n in layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                meta, found = opened(content.as_py())
                some = np.zeros(tuple(meta["size"]), dtype=bool)
                for a in found.values():
                    some |= ~np.isnan(a)
                (r, c), res = np.nonzero(some), meta["resolution"]
                x = meta["position"][0] + (meta["size"][0] / 2 - 0.5 - r) * res
                y = meta["position"][1] + (meta["size"][1] / 2 - 0.5 - c) * res
                values = [pa.array(found[n][r, c].astype(float), from_pandas=True) if n in found else pa.nulls(len(r), pa.float64()) for n in layers]
                head = [pa.array([path] * len(r), type=pa.string()), pa.array(r), pa.array(c), pa.array(x), pa.array(y), pa.array(np.full(len(r), float(res))), pa.array([meta.get("frame_id", "map")] * len(r), type=pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *values], names=["path", "row", "col", "x", "y", "resolution", "frame_id", *layers])

    return files.select("path", "content").mapInArrow(run, ddl)


def npz_metadata(files: DataFrame) -> DataFrame:
    """path, version, resolution, position, size, frame_id and names of the whole layers of archives (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [opened(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f(m, x) for m, x in got], type=t) for f, t in ((lambda m, x: m["version"], pa.int32()), (lambda m, x: m["resolution"], pa.float64()), (lambda m, x: m["position"], pa.list_(pa.float64())), (lambda m, x: m["size"], pa.list_(pa.int64())), (lambda m, x: m.get("frame_id", "map"), pa.string()), (lambda m, x: list(x), pa.list_(pa.string())))]], names=["path", "version", "resolution", "position", "size", "frame_id", "layers"])

    return files.select("path", "content").mapInArrow(run, "path string, version int, resolution double, position array<double>, size array<long>, frame_id string, layers array<string>")


def save_npz(path: str, cells: DataFrame, grid: Grid, layers: list[str] | None = None, frame_id: str = "map", tile: int = 1024) -> None:
    """A folder of tiles, in any store."""
    write_files(encoded_npz(cells, grid, layers, frame_id, tile), path)


def load_npz(spark: SparkSession, path: str) -> tuple[DataFrame, Grid, str]:
    """Cells, grid and frame of an archive, or of a folder of tiles: the smallest rectangle that holds them all."""
    files = spark.read.format("binaryFile").load(path)
    heads = npz_metadata(files).collect()  # a row an archive
    if not heads:
        raise ValueError("there is no archive")
    res = heads[0]["resolution"]
    half = lambda h, k: h["size"][k] * res / 2
    top = [max(h["position"][k] + half(h, k) for h in heads) for k in (0, 1)]
    low = [min(h["position"][k] - half(h, k) for h in heads) for k in (0, 1)]
    grid = Grid(top[0] - low[0], top[1] - low[1], res, (top[0] + low[0]) / 2, (top[1] + low[1]) / 2)
    names = list(dict.fromkeys(n for h in heads for n in h["layers"]))
    cells = decoded_npz(files, names).select(grid.row(F.col("x")).alias("row"), grid.col(F.col("y")).alias("col"), *names)
    return cells, grid, heads[0]["frame_id"]


def shade_range(cells: DataFrame, layer: str, normalize: str = "percentile_1_99", fixed: tuple[float, float] = (-2.0, 2.0)) -> tuple[float, float]:
    """The values that become the scale's ends; order statistics are elements, nothing is interpolated."""
    if normalize == "fixed_range":
        return fixed
    v = cells.where(F.col(layer).isNotNull() & ~F.isnan(layer)).select(F.col(layer).alias("v"))
    n = v.count()
    if not n:
        return 0.0, 1.0
    if normalize == "min_max":
        lo, hi = v.agg(F.min("v"), F.max("v")).first()
    else:
        lo, hi = elements(v, [int(n * 0.01), min(int(n * 0.99), n - 1)])
    return lo, hi


def elements(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values (v) of these places, from 0, in their order: ranges of values are counted, and only those looked into that hold one."""
    dealt = stored(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    out = []
    for rank in ranks:
        for part, n in counts:
            if rank < n:
                break
            rank -= n
        row = F.row_number().over(Window.partitionBy("part").orderBy("v"))
        out.append(dealt.where(F.col("part") == part).withColumn("k", row).where(F.col("k") == rank + 1).first()["v"])
    return out


def shade(value: Column, lo: float, hi: float, colormap: str = "viridis") -> dict[str, Column]:
    """r, g, b (0 to 255) and a (0 where nothing is measured)."""
    span = hi - lo if hi - lo >= 1e-6 else 1.0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / span))
    if colormap == "grayscale":
        rgb = [t] * 3
    elif colormap == "jet":
        rgb = jet(t)
    else:
        at = F.floor(t * 7).cast("int")
        stops = [F.array(*[F.lit(s[k]) for s in VIRIDIS]) for k in range(3)]
        rgb = [F.get(s, at) * (1 - (t * 7 - at)) + F.get(s, F.least(at + 1, F.lit(7))) * (t * 7 - at) for s in stops]
    measured = value.isNotNull() & ~F.isnan(value)
    out = {c: F.when(measured, F.floor(v * 255 + 0.5).cast("int")).otherwise(F.lit(0)) for c, v in zip("rgb", rgb, strict=True)}
    return out | {"a": F.when(measured, F.lit(255)).otherwise(F.lit(0))}


def jet(t: Column) -> list[Column]:
    """From blue by cyan, green and yellow to red, in four straight parts."""
    one, none = F.lit(1.0), F.lit(0.0)
    red = F.when(t < 0.5, none).when(t < 0.75, 4 * (t - 0.5)).otherwise(one)
    green = F.when(t < 0.25, 4 * t).when(t < 0.75, one).otherwise(1 - 4 * (t - 0.75))
    blue = F.when(t < 0.25, one).when(t < 0.5, 1 - 4 * (t - 0.25)).otherwise(none)
    return [red, green, blue]


def viewed(t: Column, colormap: str = "turbo") -> list[Column]:
    """Red, green and blue (0 to 255) of a viewer's colour scale at t, which is held to 0..1."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))

    def powers(c: tuple[float, ...]) -> Column:
        out = F.lit(c[-1])
        for v in reversed(c[:-1]):
            out = F.lit(v) + t * out
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))

    scale = {"turbo": lambda: [powers(c) for c in TURBO], "viridis": lambda: [powers(c) for c in SOFT_VIRIDIS], "jet": lambda: jet(t), "grayscale": lambda: [t] * 3}
    return [F.floor(v * 255).cast("int") for v in scale[colormap]()]


def colored(points: DataFrame, by: str = "intensity", colormap: str = "turbo", low: float | None = None, high: float | None = None) -> DataFrame:
    """points with r, g, b by a channel, or by range (the distance from the origin), between its least and greatest or given values.
    Rings count from 0."""
    value = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) if by == "range" else F.col(by).cast("double")
    if by == "ring" and low is None:
        low = 0.0
    if low is None or high is None:
        found = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        low, high = found["lo"] if low is None else low, found["hi"] if high is None else high
    span = (high - low) if high is not None and high - low > 1e-6 else 1.0
    return points.withColumns(dict(zip("rgb", viewed((value - F.lit(low)) / span, colormap), strict=True)))


def flagged(points: DataFrame, flag: str, yes: tuple[int, int, int] = PLANE, no: tuple[int, int, int] | None = OTHERS) -> DataFrame:
    """points with r, g, b by whether they are a plane's or ground; without a colour for the others theirs is null."""
    pick = lambda k: F.when(F.col(flag), F.lit(yes[k])).otherwise(F.lit(no[k] if no else None)).cast("int")
    return points.withColumns({c: pick(k) for k, c in enumerate("rgb")})


def shaded(cells: DataFrame, layer: str, normalize: str = "percentile_1_99", colormap: str = "viridis", fixed: tuple[float, float] = (-2.0, 2.0)) -> DataFrame:
    return cells.select(*CELL, *[v.alias(n) for n, v in shade(F.col(layer), *shade_range(cells, layer, normalize, fixed), colormap).items()])


def png_bytes(pixels: np.ndarray) -> bytes:
    """An RGBA picture, rows by columns by 4."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encoded_png(cells: DataFrame, grid: Grid, layer: str, start: tuple[int, int] = (0, 0), align_to_world: bool = False, **options: object) -> DataFrame:
    """content: the picture of a map's rectangle, which one task builds. start: where the map's corner lies in its buffer; pictures
    show the buffer as it is, or with align_to_world from the corner on. Rows and columns of cells count from the corner."""
    rows, cols = grid.rows, grid.cols
    shift = (0, 0) if align_to_world else start

    def build(part: pa.Table) -> pa.Table:
        pixels = np.zeros((rows, cols, 4), dtype=np.uint8)
        r, c = ((part.column(n).to_numpy() + k) % size for n, k, size in (("row", shift[0], rows), ("col", shift[1], cols)))
        pixels[r, c] = np.stack([part.column(n).to_numpy() for n in "rgba"], 1)
        return pa.table({"content": pa.array([png_bytes(pixels)], type=pa.binary())})

    shades = shaded(cells.where(grid.holds(F.col("row"), F.col("col"))), layer, **options)
    return shades.groupBy(F.lit(0).alias("all")).applyInArrow(build, "content binary")


def save_png(path: str, cells: DataFrame, grid: Grid, layer: str, **options: object) -> None:
    """In any store; an unknown layer raises."""
    if layer not in cells.columns:
        raise ValueError(f"no layer {layer}")
    folder, _, name = path.rpartition("/")
    write_files(encoded_png(cells, grid, layer, **options).withColumn("path", F.lit(name)), folder)
