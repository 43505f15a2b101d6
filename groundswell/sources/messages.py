"""Point-cloud, grid-map and marker messages of robot middleware, as rows: what a bag reader yields, or a publisher sends.

A cloud message is a row (frame_id, stamp, width, height, fields, point_step, data): fields say at which offset of a
point each channel lies and of which type it is. Messages are decoded side by side, each vectorised; encoding takes what
one message holds, a scan or a map's rectangle, through one task in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import Grid
from ..operators.raster import CELL
from .pieces import PIECE, contents, cut, in_order, runs, spooled

#: Numbers of field types in messages, with numpy's. (fixed values)
INT8, UINT8, INT16, UINT16, INT32, UINT32, FLOAT32, FLOAT64 = range(1, 9)
TYPES = {INT8: "<i1", UINT8: "<u1", INT16: "<i2", UINT16: "<u2", INT32: "<i4", UINT32: "<u4", FLOAT32: "<f4", FLOAT64: "<f8"}
#: Which types a channel is read from; of any other type it is 0. (fixed values)
READABLE = {"intensity": (UINT8, UINT16, FLOAT32, FLOAT64), "ring": (UINT8, UINT16, INT32), "t": (FLOAT32, FLOAT64, UINT32), "label": (UINT8, UINT16, UINT32, INT32)}
#: Other names of fields, with the channel's. (fixed values)
ALIASES = {"time": "t", "timestamp": "t", "rgb": "color", "rgba": "color", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}
#: Channels in the order that encoding writes them, with field names and types. (fixed values)
WRITTEN = (("intensity", "intensity", FLOAT32), ("ring", "ring", UINT16), ("t", "time", FLOAT32), ("color", "rgb", FLOAT32), ("label", "label", UINT32), ("nx", "normal_x", FLOAT32), ("ny", "normal_y", FLOAT32), ("nz", "normal_z", FLOAT32))
CHANNELS = {"x": "double", "y": "double", "z": "double", "intensity": "double", "ring": "int", "t": "double", "color": "int", "label": "long", "nx": "double", "ny": "double", "nz": "double"}
FIELD = "struct<name:string,offset:int,datatype:int,count:int>"
MESSAGE = f"frame_id string, stamp double, height int, width int, fields array<{FIELD}>, is_bigendian boolean, point_step int, row_step int, data binary, is_dense boolean"


def message_points(fields: list[dict], step: int, data: bytes | memoryview, count: int, big: bool = False) -> dict[str, np.ndarray]:
    """Channels of a message's points with finite coordinates."""
    count = min(count, len(data) // step) if step else 0
    raw = np.frombuffer(data, dtype=np.uint8, count=count * step).reshape(count, step)

    def read(f: dict, kind: str) -> np.ndarray:
        kind = kind.replace("<", ">") if big else kind
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(raw[:, f["offset"] : f["offset"] + size]).view(kind)[:, 0]

    at = {ALIASES.get(f["name"], f["name"]): f for f in fields}
    out: dict[str, np.ndarray] = {}
    for name in ("x", "y", "z", "nx", "ny", "nz"):
        if name in at:
            out[name] = read(at[name], "<f4").astype(float)
    if not {"x", "y", "z"} <= set(out):
        raise ValueError("a message without x, y and z")
    for name, kinds in READABLE.items():
        if name in at:
            kind = at[name]["datatype"]
            out[name] = read(at[name], TYPES[kind]).astype(float) if kind in kinds else np.zeros(count)
            if name == "t" and kind == UINT32:
                out[name] = out[name] * 1e-9
    if "color" in at:
        out["color"] = read(at["color"], "<u4").astype(np.int64) & 0xFFFFFF
    sound = np.isfinite(out["x"]) & np.isfinite(out["y"]) & np.isfinite(out["z"])
    return {c: v[sound] for c, v in out.items()}


def decoded(messages: DataFrame, key: str = "scan_id") -> DataFrame:
    """key, frame_id, stamp, point_id (place among the message's sound points) and channels; those that a message lacks are null.
    messages may come in pieces, as `encoded` makes them."""
    schema = messages.select(key, "frame_id", "stamp", F.lit(0).cast("long").alias("point_id"), *[F.lit(None).cast(t).alias(c) for c, t in CHANNELS.items()]).schema
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    about = ["fields", "point_step", "width", "height", "is_bigendian"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, place, left = (None, -1), b"", 0, 0
        for batch in batches:
            heads = [batch.column(i).slice for i in range(3)]
            rows = batch.select(about).to_pylist()
            for i, fresh, data, before in contents(batch, key, "data", before):
                m, step = rows[i], rows[i]["point_step"]
                if fresh:
                    held, place, left = b"", 0, m["width"] * m["height"]
                data = memoryview(held + data.to_pybytes() if held else data)
                whole = min(left, len(data) // step) if step else 0
                held, left = (bytes(data[whole * step :]) if left > whole and step else b""), left - whole
                most = max(1, PIECE // step) if step else 1
                for lo in range(0, max(1, whole), most):
                    got = message_points(m["fields"], step, data[lo * step : (lo + most) * step], min(most, whole - lo), bool(m["is_bigendian"]))
                    n = len(got["x"])
                    repeat = pa.array(np.zeros(n, dtype=np.int64))
                    same = [h(i, 1).take(repeat) for h in heads]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(place, place + n)), *[pa.array(got[c]).cast(kinds[t], safe=False) if c in got else pa.nulls(n, kinds[t]) for c, t in CHANNELS.items()]], names=schema.names)
                    place += n

    names = [key, "frame_id", "stamp", *about, *["piece"] * ("piece" in messages.columns), "data"]
    return messages.select(*names).mapInArrow(run, schema)


def packed(columns: dict[str, np.ndarray], floats: tuple[str, ...] = ()) -> tuple[list[tuple[str, int, int, int]], int, bytes]:
    """Fields, point step and data of points: x, y, z, the channels that are there, in their order; or x, y, z and `floats`, with
    a colour last."""
    if floats:
        chosen = [(c, c, FLOAT32) for c in floats if c != "color"] + [("color", "rgb", FLOAT32)] * ("color" in floats)
    else:
        chosen = [w for w in WRITTEN if w[0] in columns]
    fields, offset, kinds = [], 0, []
    for _, name, kind in [(c, c, FLOAT32) for c in "xyz"] + chosen:
        fields.append((name, offset, kind, 1))
        kinds.append((name, "<u4" if name == "rgb" else TYPES[kind]))
        offset += np.dtype(TYPES[kind]).itemsize
    record = np.zeros(len(columns["x"]), dtype=kinds)
    for channel, name, _ in [(c, c, FLOAT32) for c in "xyz"] + chosen:
        v = np.asarray(columns[channel], dtype=float)
        record[name] = v if record[name].dtype.kind == "f" else np.nan_to_num(v)
    return fields, offset if len(record) else 0, record.tobytes()


def encoded(points: DataFrame, by: str = "scan_id", frame_id: str = "map", stamp: Column | None = None, floats: tuple[str, ...] = (), piece: int | None = None) -> DataFrame:
    """by and a message of all its points, in order of their ids.

    piece: also `piece`; the message's data in pieces of so many bytes at most, in order, each with the whole message's head, for
    messages too large for one value. A scan passes one task, in batches; its data waits, beyond `HELD` on disk, until its end.
    """
    names = [c for c in points.columns if c in floats or (not floats and c in CHANNELS) or c in "xyz"]
    rows = in_order(points, by, names, __stamp=(stamp if stamp is not None else F.lit(0.0)).cast("double"))
    ddl = f"{by} {points.schema[by].dataType.simpleString()}, {'piece int, ' if piece is not None else ''}{MESSAGE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> Iterator[pa.RecordBatch]:
            head = {"frame_id": frame_id, "stamp": when, "height": 1, "width": n, "fields": [dict(zip(("name", "offset", "datatype", "count"), f, strict=True)) for f in fields], "is_bigendian": False, "point_step": step, "row_step": step * n, "is_dense": True}
            for k, data in cut(b"", held, piece):
                row = pa.RecordBatch.from_pylist([head | {"data": data}], schema=MESSAGE_ARROW)
                numbered = {"piece": pa.array([k], type=pa.int32())} if piece is not None else {}
                yield pa.RecordBatch.from_arrays([key, *numbered.values(), *row.columns], names=[by, *numbered, *MESSAGE_ARROW.names])
            held.close()

        held = None
        for fresh, some in runs(batches):
            if fresh:
                if held:
                    yield from closed()
                held, n, when, key = spooled(), 0, None, some.column(0).slice(0, 1)
            fields, step, data = packed({c: some.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names}, floats)
            held.write(data)
            n += len(some)
            if len(stamps := some.column("__stamp").drop_null().to_numpy()):
                when = stamps.max() if when is None else np.maximum(when, stamps.max())
        if held:
            yield from closed()

    return rows.mapInArrow(run, ddl)


MESSAGE_ARROW = pa.schema([("frame_id", pa.string()), ("stamp", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int32()), ("datatype", pa.int32()), ("count", pa.int32())]))), ("is_bigendian", pa.bool_()), ("point_step", pa.int32()), ("row_step", pa.int32()), ("data", pa.binary()), ("is_dense", pa.bool_())])

Region = tuple[int, int, int, int]


def within(cells: DataFrame, region: Region | None) -> DataFrame:
    """Cells of a part of the map: first row and column, and how many of each."""
    if region is None:
        return cells
    r, c, rows, cols = region
    return cells.where(F.col("row").between(r, r + rows - 1) & F.col("col").between(c, c + cols - 1))


def map_points(cells: DataFrame, grid: Grid, region: Region | None = None) -> DataFrame:
    """Measured cells, of a region or of all, as points with all public layers; elevation is z."""
    layers = [c for c in cells.columns if c not in (*CELL, "elevation") and not c.startswith("_")]
    return within(cells, region).where(F.col("elevation").isNotNull()).select((F.col("col") * grid.rows + F.col("row")).alias("point_id"), grid.x_of(F.col("row")).alias("x"), grid.y_of(F.col("col")).alias("y"), F.col("elevation").alias("z"), *layers)


def map_message(cells: DataFrame, grid: Grid, region: Region | None = None, frame_id: str = "map", stamp: float = 0.0) -> DataFrame:
    """One cloud message of a map's rectangle, cells column by column."""
    points = map_points(cells, grid, region)
    floats = tuple(c for c in points.columns if c not in ("point_id", "x", "y", "z"))
    return encoded(points.withColumn("part", F.lit(0)), "part", frame_id, F.lit(stamp), floats).drop("part")


def grid_message(cells: DataFrame, grid: Grid, frame_id: str = "map") -> DataFrame:
    """A row for each public layer of a map: layer, resolution, lengths, place, rows, cols, and data column by column with NaN where
    nothing is measured. A layer of a map's rectangle is what one message holds."""
    layers = [c for c in cells.columns if c not in CELL and not c.startswith("_")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).cast("double").alias("v")) for c in layers]))
    long = cells.where(grid.holds(F.col("row"), F.col("col"))).select((F.col("col") * grid.rows + F.col("row")).alias("at"), pairs.alias("e")).where("e.v IS NOT NULL").groupBy("e.layer").agg(F.collect_list(F.struct("at", "e.v")).alias("cells"))
    rows, cols = grid.rows, grid.cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(batch.column(1)):
                data = np.full(rows * cols, np.nan, dtype="<f4")
                flat = found.values
                data[flat.field("at").to_numpy()] = flat.field("v").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([data.tobytes()])], names=["layer", "data"])

    info = {"frame_id": F.lit(frame_id), "resolution": F.lit(grid.resolution), "length_x": F.lit(rows * grid.resolution), "length_y": F.lit(cols * grid.resolution), "centre_x": F.lit(float(grid.centre_x)), "centre_y": F.lit(float(grid.centre_y)), "rows": F.lit(rows), "cols": F.lit(cols), "basic": F.col("layer") == "elevation"}
    return long.mapInArrow(run, "layer string, data binary").withColumns(info)


def boundary(spark, grid: Grid, z: float = 0.0) -> DataFrame:  # noqa: ANN001
    """A closed line around a map: nth, x, y, z of its five corners, the first again last."""
    x, y = grid.rows * grid.resolution / 2, grid.cols * grid.resolution / 2
    corners = [(x, y), (x, -y), (-x, -y), (-x, y), (x, y)]
    return spark.createDataFrame([(i, grid.centre_x + a, grid.centre_y + b, z) for i, (a, b) in enumerate(corners)], "nth int, x double, y double, z double")


def normal_markers(cells: DataFrame, grid: Grid, stride: int = 1, length: float = 0.15) -> DataFrame:
    """Lines from cells along their normals, at every so many rows and columns: both ends, and a colour redder the steeper."""
    stride = max(stride, 1)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("slope") / 45.0)), F.lit(0.0))
    at = cells.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0) & F.col("nx").isNotNull() & F.col("elevation").isNotNull())
    start = {"x": grid.x_of(F.col("row")), "y": grid.y_of(F.col("col")), "z": F.col("elevation")}
    ends = [(v + F.col(f"n{c}") * length).alias(f"{c}1") for c, v in start.items()]
    return at.select("row", "col", *[v.alias(c) for c, v in start.items()], *ends, t.alias("r"), (0.8 * (1 - t)).alias("g"), F.lit(0.0).alias("b"), F.lit(0.8).alias("a"))
