"""Clouds as streams: the points of a scan pass one task in their order, batch by batch, and so do the bytes of a file.

A file, or a message, may be a row, or several that follow one another in a partition and are numbered by `piece` from 0.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a piece where files and messages travel in pieces, and of what is decoded at once.
PIECE = 1 << 20
#: Bytes of a file that is being encoded which are held in memory; what goes beyond waits in a temporary file.
HELD = 1 << 26


def in_order(points: DataFrame, by: str, names: list[str], **more: Column) -> DataFrame:
    """by, point_id, names and more; the points of a scan lie in one partition, in order of their ids. The sort can spill."""
    chosen = points.select(by, "point_id", *names, *[c.alias(n) for n, c in more.items()])
    return chosen.repartition(by).sortWithinPartitions(by, "point_id", *names)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Stretches of a batch with one key (the first column), and whether the key is another than before."""
    seen, last = False, None
    for batch in batches:
        found, at = pc.run_end_encode(batch.column(0)), 0
        for key, end in zip(found.values.to_pylist(), found.run_ends.to_pylist(), strict=True):
            yield not seen or key != last, batch.slice(at, end - at)
            seen, last, at = True, key, end


def spooled() -> IO[bytes]:
    return tempfile.SpooledTemporaryFile(max_size=HELD)


def cut(head: bytes, body: IO[bytes], piece: int | None) -> Iterator[tuple[int, bytes]]:
    """The bytes of head and body, in order, as numbered pieces; as one, if no size is given."""
    body.seek(0)
    if piece is None:
        yield 0, head + body.read()
        return
    rest, k = head, 0
    while (rest := rest + body.read(max(0, piece - len(rest)))) or not k:
        yield k, rest[:piece]
        rest, k = rest[piece:], k + 1


def contents(batch: pa.RecordBatch, key: str, content: str, before: tuple[object, int]) -> Iterator[tuple[int, bool, pa.Buffer, tuple[object, int]]]:
    """Row, whether a file begins there, its bytes, and key and number to bring along to the next batch."""
    keys = batch.column(key).to_pylist()
    numbers = batch.column("piece").to_pylist() if "piece" in batch.schema.names else [0] * len(keys)
    for i, at in enumerate(zip(keys, numbers, strict=True)):
        if at[1] and at != (before[0], before[1] + 1):
            raise ValueError(f"piece {at[1]} of {at[0]} does not follow its piece {at[1] - 1}")
        before = at
        yield i, not at[1], batch.column(content)[i].as_buffer(), before


def slices(data: pa.Buffer) -> Iterator[memoryview]:
    view = memoryview(data)
    for lo in range(0, len(view), PIECE):
        yield view[lo : lo + PIECE]
