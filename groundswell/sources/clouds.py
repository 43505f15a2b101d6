"""Point-cloud files: headless float records and PCD, read in parallel by file, written a file for each partition or scan.

Reads go through Spark's binaryFile source and so through any store it knows; the parsing is vectorised by file.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pieces import contents, cut, in_order, runs, slices, spooled

#: PCD type letters and sizes that are decoded, with their numpy types; others read as 0. (fixed values)
PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 4): "<u4", ("I", 4): "<i4"}
#: Other names of channels in PCD files. (fixed values)
ALIASES = {"i": "intensity", "reflectivity": "intensity", "rgba": "rgb", "nx": "normal_x", "ny": "normal_y", "nz": "normal_z"}
CHANNELS = {"x": "double", "y": "double", "z": "double", "intensity": "double", "rgb": "int", "normal_x": "double", "normal_y": "double", "normal_z": "double"}
#: The line that ends a PCD header.
HEADER_END = re.compile(rb"^[^\S\n]*DATA(?:[^\S\n][^\n]*)?\n", re.IGNORECASE | re.MULTILINE)
NAMES = {"rgb": "color", "normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _emit(frames: Iterator[tuple[str, int, dict[str, np.ndarray]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of file, place of the first point, and channels; those that are not there are null."""
    for file, first, columns in frames:
        n = len(next(iter(columns.values())))
        for lo in range(0, n, 1 << 16):
            hi = min(n, lo + (1 << 16))
            parts = [pa.array([file] * (hi - lo)), pa.array(np.arange(first + lo, first + hi))] + [pa.array(columns[f.name][lo:hi]).cast(f.type) if f.name in columns else pa.nulls(hi - lo, f.type) for f in schema if f.name not in ("file", "point_id")]
            yield pa.RecordBatch.from_arrays(parts, schema=schema)


class Reader:
    """Takes the bytes of a file as they come, and gives the channels of the points that they complete."""

    def fed(self, data: bytes | memoryview) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def rest(self) -> dict[str, np.ndarray]:
        """What is left at the file's end."""
        return {}


def _read(files: DataFrame, reader: Callable[[], Reader], columns: dict[str, str]) -> DataFrame:
    ddl, schema = _arrow(columns)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict[str, np.ndarray]]]:
        before, open_, place = (None, -1), None, 0
        for batch in batches:
            for _, fresh, data, at in contents(batch, "path", "content", before):
                if fresh:
                    if open_ and (got := open_.rest()):
                        yield before[0], place, got
                    open_, place = reader(), 0
                before = at
                for part in slices(data):
                    if got := open_.fed(part):
                        yield at[0], place, got
                        place += len(got["x"])
        if open_ and (got := open_.rest()):
            yield before[0], place, got

    return files.select(*[c for c in ("path", "content", "piece") if c in files.columns]).mapInArrow(lambda b: _emit(frames(b), schema), ddl)


def _arrow(columns: dict[str, str]) -> tuple[str, pa.Schema]:
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    every = {"file": "string", "point_id": "long"} | columns
    return ", ".join(f"{n} {t}" for n, t in every.items()), pa.schema([(n, kinds[t]) for n, t in every.items()])


def read_bin(spark: SparkSession, path: str, fields: int = 4, intensity: int | None = 3, ring: int | None = None) -> DataFrame:
    return decoded_bin(_files(spark, path), fields, intensity, ring)


class BinReader(Reader):
    def __init__(self, fields: int, intensity: int | None, ring: int | None) -> None:
        self.fields, self.intensity, self.ring, self.held = fields, intensity, ring, b""

    def fed(self, data: bytes | memoryview) -> dict[str, np.ndarray]:
        data = self.held + bytes(data)
        n = len(data) // (4 * self.fields)
        self.held = data[4 * self.fields * n :]
        raw = np.frombuffer(data, dtype="<f4", count=n * self.fields).reshape(-1, self.fields)
        out = {c: raw[:, k].astype(float) for k, c in enumerate("xyz")}
        if self.intensity is not None:
            out["intensity"] = raw[:, self.intensity].astype(float)
        if self.ring is not None:
            out["ring"] = raw[:, self.ring].astype(np.int32)
        return out


def decoded_bin(files: DataFrame, fields: int = 4, intensity: int | None = 3, ring: int | None = None) -> DataFrame:
    """Of files (path, content[, piece]): file, point_id (place in the file), x, y, z, intensity[, ring]; a last record that is cut short is left out."""
    columns = {"x": "double", "y": "double", "z": "double"} | ({"intensity": "double"} if intensity is not None else {}) | ({"ring": "int"} if ring is not None else {})
    return _read(files, lambda: BinReader(fields, intensity, ring), columns)


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    return read_bin(spark, path)


def read_nuscenes(spark: SparkSession, path: str) -> DataFrame:
    return read_bin(spark, path, fields=5, ring=4)


def pcd_header(content: bytes) -> tuple[dict[str, list[str]], bytes]:
    """The header's fields, and what follows it."""
    header: dict[str, list[str]] = {}
    stream = io.BytesIO(content)
    while line := stream.readline():
        words = line.decode("ascii", "replace").split("#")[0].split()
        if words:
            header[words[0].upper()] = words[1:]
            if words[0].upper() == "DATA":
                break
    if "FIELDS" not in header or "DATA" not in header:
        raise ValueError("not a PCD file: FIELDS or DATA is missing")
    if header["DATA"][0].lower() == "binary_compressed":
        raise ValueError("compressed PCD data is not supported")
    header.setdefault("COUNT", ["1"] * len(header["FIELDS"]))
    return header, stream.read()


class PcdReader(Reader):
    def __init__(self) -> None:
        self.held, self.header = b"", None

    def begun(self, data: bytes) -> bytes:
        """Takes the header off, and keeps what it says of the points."""
        header, data = pcd_header(data)
        self.left = int(header["WIDTH"][0]) * int(header.get("HEIGHT", ["1"])[0])
        self.kinds = [(t.upper(), int(s)) for t, s in zip(header["TYPE"], header["SIZE"], strict=True)]
        self.counts = list(map(int, header["COUNT"]))
        self.names = [ALIASES.get(f.lower(), f.lower()) for f in header["FIELDS"]]
        self.record = np.dtype([(f"f{i}", PCD_TYPES.get(k, f"V{k[1]}"), (c,)) for i, (k, c) in enumerate(zip(self.kinds, self.counts, strict=True))])
        self.header = header
        return data

    def fed(self, data: bytes | memoryview, last: bool = False) -> dict[str, np.ndarray]:
        data = self.held + bytes(data)
        if self.header is None:
            if not last and not HEADER_END.search(data):
                self.held = data
                return {}
            data = self.begun(data)
        out: dict[str, np.ndarray] = {}
        if self.header["DATA"][0].lower() == "ascii":
            end = len(data) if last else data.rfind(b"\n") + 1
            rows = [r for line in data[:end].decode("ascii", "replace").splitlines() if (r := line.split())][: self.left]
            self.left -= len(rows)
            at = 0
            for name, kind, count in zip(self.names, self.kinds, self.counts, strict=True):
                if name in CHANNELS:
                    out[name] = np.array([float(r[at]) for r in rows]) if kind in PCD_TYPES else np.zeros(len(rows))
                at += count
            if "rgb" in out and self.kinds[self.names.index("rgb")][0] == "F":
                out["rgb"] = out["rgb"].astype("<f4").view("<i4")
        else:
            points = np.frombuffer(data, dtype=self.record, count=min(self.left, len(data) // self.record.itemsize))
            self.left -= len(points)
            end = len(points) * self.record.itemsize
            for i, (name, kind) in enumerate(zip(self.names, self.kinds, strict=True)):
                if name in CHANNELS:
                    v = points[f"f{i}"][:, 0]
                    v = np.ascontiguousarray(v).view("<i4") if name == "rgb" and kind == ("F", 4) else v
                    out[name] = v if kind in PCD_TYPES else np.zeros(len(points))
        self.held = data[end:] if self.left else b""
        if "rgb" in out:
            out["rgb"] = out["rgb"].astype(np.int64) & 0xFFFFFF
        return {NAMES.get(c, c): v for c, v in out.items()}

    def rest(self) -> dict[str, np.ndarray]:
        return self.fed(b"", last=True)


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    return decoded_pcd(_files(spark, path))


def decoded_pcd(files: DataFrame) -> DataFrame:
    """Of files (path, content[, piece]): file, point_id, x, y, z, intensity, color, nx, ny, nz; channels that a file lacks are null."""
    return _read(files, PcdReader, {NAMES.get(n, n): t for n, t in CHANNELS.items()})


def read_pcd_metadata(spark: SparkSession, path: str) -> DataFrame:
    return pcd_metadata(_files(spark, path))


def pcd_metadata(files: DataFrame) -> DataFrame:
    """Of files (path, content[, piece]): file, width, height, viewpoint (tx, ty, tz, qw, qx, qy, qz)."""
    if "piece" in files.columns:  # the header is in the first
        files = files.where("piece = 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [pcd_header(c.as_py())[0] for c in batch.column(1)]
            view = [list(map(float, h.get("VIEWPOINT", ["0", "0", "0", "1", "0", "0", "0"]))) for h in heads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(h["WIDTH"][0]) for h in heads]), pa.array([int(h.get("HEIGHT", ["1"])[0]) for h in heads]), pa.array(view)], names=["file", "width", "height", "viewpoint"])

    return files.select("path", "content").mapInArrow(run, "file string, width long, height long, viewpoint array<double>")


def bin_bytes(columns: dict[str, np.ndarray], ring: bool = False) -> bytes:
    n = len(columns["x"])
    names = ["x", "y", "z", "intensity", *["ring"] * ring]
    return np.stack([np.asarray(columns.get(c, np.zeros(n)), dtype=float) for c in names], 1).astype("<f4").tobytes()


def _pcd_fields(names: Iterable[str]) -> tuple[list[str], list[str]]:
    there = [c for c in CHANNELS if NAMES.get(c, c) in names]
    return there, ["U" if c == "rgb" else "F" for c in there]


def pcd_head(names: Iterable[str], n: int, binary: bool = True, viewpoint: tuple[float, ...] = (0, 0, 0, 1, 0, 0, 0)) -> bytes:
    there, kinds = _pcd_fields(names)
    head = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS " + " ".join(there), "SIZE " + " ".join(["4"] * len(there)), "TYPE " + " ".join(kinds), "COUNT " + " ".join(["1"] * len(there)), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT " + " ".join(f"{v:g}" for v in viewpoint), f"POINTS {n}", f"DATA {'binary' if binary else 'ascii'}", ""]
    return "\n".join(head).encode()


def pcd_body(columns: dict[str, np.ndarray], binary: bool = True, precision: int = 8) -> bytes:
    there, kinds = _pcd_fields(columns)
    values = [np.asarray(columns[NAMES.get(c, c)]) for c in there]
    if binary:
        record = np.zeros(len(columns["x"]), dtype=[(c, "<u4" if k == "U" else "<f4") for c, k in zip(there, kinds, strict=True)])
        for c, v in zip(there, values, strict=True):
            record[c] = v
        return record.tobytes()
    line = " ".join("%d" if k == "U" else f"%.{precision}g" for k in kinds) + "\n"
    return "".join([line % r for r in zip(*[v.tolist() for v in values], strict=True)]).encode()


def pcd_bytes(columns: dict[str, np.ndarray], binary: bool = True, viewpoint: tuple[float, ...] = (0, 0, 0, 1, 0, 0, 0), precision: int = 8) -> bytes:
    """x, y, z and, where there, intensity, rgb and normals, as one row of points."""
    return pcd_head(columns, len(columns["x"]), binary, viewpoint) + pcd_body(columns, binary, precision)


def encoded(points: DataFrame, kind: str = "pcd", by: str = "scan_id", piece: int | None = None, **options: object) -> DataFrame:
    """by, content: the file of each scan as bytes, points in order of their ids; a scan is what one file can hold.

    piece: by, piece, content: the file in pieces of so many bytes at most, in order, for files too large for one value. A scan
    passes one task, in batches; its bytes wait until the header can say how many points there are, beyond `HELD` on disk.
    """
    names = [c for c in points.columns if c in {NAMES.get(c, c) for c in CHANNELS} | {"ring"}]
    if kind == "pcd":
        head = lambda n: pcd_head(names, n, **{k: v for k, v in options.items() if k != "precision"})
        body = lambda columns: pcd_body(columns, **{k: v for k, v in options.items() if k != "viewpoint"})
    else:
        head, body = {"bin": (lambda n: b"", lambda columns: bin_bytes(columns, **options))}[kind]
    out = [by, *["piece"] * (piece is not None), "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> Iterator[pa.RecordBatch]:
            for k, content in cut(head(n), held, piece):
                yield pa.RecordBatch.from_arrays([key, *[pa.array([k], type=pa.int32())] * (piece is not None), pa.array([content], type=pa.binary())], names=out)
            held.close()

        held = None
        for fresh, rows in runs(batches):
            if fresh:
                if held:
                    yield from closed()
                held, n, key = spooled(), 0, rows.column(0).slice(0, 1)
            held.write(body({c: rows.column(c).to_numpy(zero_copy_only=False) for c in names}))
            n += len(rows)
        if held:
            yield from closed()

    return in_order(points, by, names).mapInArrow(run, f"{by} {points.schema[by].dataType.simpleString()}, {'piece int, ' if piece is not None else ''}content binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Files (path, content) into a folder of any store that Spark knows, one after another through the driver."""
    from ..plans.tables import file_system

    for row in files.select("path", "content").toLocalIterator():
        fs, at = file_system(files.sparkSession, f"{folder}/{row['path']}" if folder else row["path"])
        out = fs.create(at, True)
        out.write(row["content"])
        out.close()


def from_columns(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    """Points of another library's cloud, channel by channel; point_id is their place."""
    n = len(columns["x"])
    ids = {} if "point_id" in columns else {"point_id": np.arange(n)}
    return spark.createDataFrame(pa.table({c: pa.array(v) for c, v in (ids | columns).items()}))
