"""The map as a stream: micro-batches of scans fold into versioned tables of cell states.

A batch writes the states of the cells that it touched to a fresh path, then one commit: a file, named by its version
and renamed into place, that says which tables the version consists of (a base and deltas since), which batch of which
source it comes from, and how far time has come. A version exists when its commit does, so readers see whole versions.
A batch that is run again finds its number committed and does nothing; one that failed before its commit left only
files that no version names. A new process goes on from the newest commit. After a number of deltas the next batch
writes a new base instead, and files that only older versions name are deleted.

Scans whose time lies more than `lateness` behind the newest of earlier batches are late and left out, and counted.
In a local map a cell that the window leaves is lost: within a batch the fold resets it; for cells that a batch does
not touch its commit keeps the rectangle that all its windows cover, and only cells in the rectangles of all later
batches are read.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import Grid
from ..operators.estimate import P2_STATE, state_type
from ..operators.raster import CELL
from ..plans.mapper import Mapper
from ..plans.tables import file_system, shared_dir, stored


@dataclass(frozen=True)
class Version:
    """What a commit says. deltas: [path, rectangle that windows kept, or none], oldest first; sources: the last batch of each."""

    number: int = -1
    base: str | None = None
    deltas: tuple[tuple[str, tuple[int, int, int, int] | None], ...] = ()
    sources: dict[str, int] = field(default_factory=dict)
    newest: float | None = None
    last_scan: int | None = None
    late: int = 0

    @property
    def paths(self) -> set[str]:
        return {p for p, _ in self.deltas} | ({self.base} if self.base else set())


class StreamingMapper:
    """folder: where versions lie (shared by driver and executors); an existing one is gone on from. One writer at a time."""

    def __init__(self, spark: SparkSession, mapper: Mapper, folder: str | None = None, lateness: float | None = None, compact_every: int = 10) -> None:
        self.spark, self.mapper, self.lateness, self.compact_every = spark, mapper, lateness, compact_every
        self.folder = folder or f"{shared_dir(spark)}/map-{uuid.uuid4().hex}"
        self.version = self._newest()

    # --- versions ---

    def _commits(self) -> str:
        return f"{self.folder}/commits"

    def _listed(self) -> list[int]:
        fs, at = file_system(self.spark, self._commits())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> Version:
        text = "".join(r["value"] for r in self.spark.read.text(f"{self._commits()}/{number:012d}.json").collect())
        d = json.loads(text)
        return Version(**d | {"deltas": tuple((p, tuple(b) if b else None) for p, b in d["deltas"])})

    def _newest(self) -> Version:
        numbers = self._listed()
        return self._read(numbers[-1]) if numbers else Version()

    def _commit(self, version: Version) -> None:
        """Written aside, then renamed: the commit is there whole or not at all, and no other writer's is replaced."""
        fs, at = file_system(self.spark, f"{self._commits()}/{version.number:012d}.json")
        aside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/aside-{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(dataclasses.asdict(version)).encode()))
        out.close()
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(aside, at):
            raise RuntimeError(f"version {version.number} was committed by another writer")
        self.version = version

    def _tidied(self) -> None:
        """Deletes tables that neither this version nor the one before names."""
        numbers = self._listed()
        keep = set().union(*(self._read(n).paths for n in numbers[-2:]))
        fs, at = file_system(self.spark, f"{self.folder}/states")
        for f in fs.listStatus(at) if fs.exists(at) else []:
            if not any(p.endswith("/" + f.getPath().getName()) for p in keep):
                fs.delete(f.getPath(), True)

    # --- states ---

    @property
    def state_type(self) -> str:
        return P2_STATE if self.mapper.config.estimator == "p2_quantile" else state_type(True)

    def states(self, version: Version | None = None) -> DataFrame | None:
        """row, col, state of a version: of each cell the youngest there is, of those that no window since has left."""
        v = version or self.version
        tables = ([(v.base, None)] if v.base else []) + list(v.deltas)
        if not tables:
            return None
        read = lambda p: self.spark.read.schema(f"row long, col long, state {self.state_type}").parquet(p)
        if len(tables) == 1:
            return read(tables[0][0])
        out = None
        for k, (path, _) in enumerate(tables):
            some = read(path).withColumn("k", F.lit(k))
            for _, box in tables[k + 1 :]:
                if box:
                    some = some.where(F.col("row").between(box[0], box[1]) & F.col("col").between(box[2], box[3]))
            out = some if out is None else out.unionByName(some)
        return out.groupBy(*CELL).agg(F.max_by("state", "k").alias("state"))

    def layers(self, version: Version | None = None) -> DataFrame:
        v = version or self.version
        states = self.states(v)
        if states is None:
            states = self.spark.createDataFrame([], f"row long, col long, state {self.state_type}")
        return self.mapper.layers(states, v.last_scan)

    # --- batches ---

    def integrate(self, points: DataFrame, batch: int, source: str = "") -> bool:
        """One micro-batch of a source; whether it made a version (one that was committed before does not)."""
        v = self.version
        if batch <= v.sources.get(source, -1):
            return False
        sources = v.sources | {source: batch}
        scans, late = None, 0
        if "scan_ts" in points.columns:
            scans = stored(points.groupBy("scan_id").agg(F.max(F.col("scan_ts").cast("double")).alias("__ts")), "scans")
            if self.lateness is not None and v.newest is not None:
                behind = scans.where(F.col("__ts") < v.newest - self.lateness)
                late = behind.count()
                points = points.join(behind.select("scan_id"), "scan_id", "left_anti") if late else points
        prepared = stored(self.mapper.preprocessed(points), "prepared")
        if prepared.isEmpty():  # a frame without points has no effect, nor does its window
            self._commit(dataclasses.replace(v, number=v.number + 1, sources=sources, late=v.late + late))
            return True
        at = self.mapper.windows(prepared) if self.mapper.is_local else None
        facts = stored(self.mapper.facts(prepared), "facts")
        cells = stored(self.mapper.events(prepared, facts, at, before=True), "events")
        box = self.mapper.kept(at) if at is not None else None
        old = self.states(v)
        path = f"{self.folder}/states/{v.number + 1}-{uuid.uuid4().hex}"
        touched = self.mapper.folded(cells if old is None else cells.join(old, list(CELL), "left"), start=None if old is None else "state")
        whole = len(v.deltas) + 1 >= self.compact_every
        if whole and old is not None:
            stay = old.where(F.col("row").between(box[0], box[1]) & F.col("col").between(box[2], box[3])) if box else old
            touched = touched.unionByName(stay.join(cells.select(*CELL).distinct(), list(CELL), "left_anti"))
        touched.select(*CELL, F.col("state").cast(self.state_type).alias("state")).write.parquet(path)
        newest = scans.agg(F.max("__ts")).first()[0] if scans is not None else None
        last = facts.agg(F.max("scan_id").cast("long")).first()[0]
        tables = {"base": path, "deltas": ()} if whole else {"deltas": (*v.deltas, (path, box))}
        self._commit(dataclasses.replace(v, number=v.number + 1, sources=sources, late=v.late + late, newest=max((x for x in (v.newest, newest) if x is not None), default=None), last_scan=v.last_scan if last is None else last, **tables))
        if whole:
            self._tidied()
        return True

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(lambda batch, k: self.integrate(batch, k, checkpoint)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def reset(self) -> None:
        """A version with an empty map. Batches go on from where their sources are."""
        v = self.version
        self._commit(Version(v.number + 1, sources=v.sources, newest=v.newest, late=v.late))


def scans(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A stream of scan files (Parquet) in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def pooled_states(stream: DataFrame, grid: Grid) -> DataFrame:
    """Order-free layers (bounds, count) as a streaming aggregation, for sinks that take updates."""
    return grid.celled(stream).groupBy(*CELL).agg(F.min("z").alias("elevation_min"), F.max("z").alias("elevation_max"), F.count(F.lit(1)).alias("n_points"))


__all__ = ["StreamingMapper", "Version", "pooled_states", "scans"]
