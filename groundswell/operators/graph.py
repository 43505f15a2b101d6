"""Connected components of an edge list, by large-star and small-star steps over tables in the shared folder. A graph of
few edges is done in one task, where rounds of jobs would cost more than the work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.tables import stored

FEW = 100_000  # edges up to which one task does all: some megabytes
MANY = 1_000_000  # edges from which on nodes with very many of them are looked for
HOT = 1000  # such a node has more than one in so many edges, so there are fewer of them


def met_with_least(both: DataFrame, edges: int) -> DataFrame:
    """both (u, v; at most so many) with m, the least v of u. The largest stars' centres are broadcast, so that no task
    gets all edges of one."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = [r["u"] for r in least.where(F.col("n") > edges / HOT).select("u").collect()] if edges > MANY else []  # fewer than HOT
    if not hot:
        return both.join(least.select("u", "m"), "u")
    named = both.sparkSession.createDataFrame([(u,) for u in hot], both.select("u").schema)
    few = least.select("u", "m").join(F.broadcast(named), "u", "left_semi")
    return both.join(F.broadcast(few), "u").union(both.join(F.broadcast(named), "u", "left_anti").join(least.select("u", "m"), "u"))


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges (u, v), but for nodes that name theirs: least labels go along edges, then along labels."""
    parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    ends = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), dtype=np.int64)
    nodes, flat = np.unique(ends, return_inverse=True)
    u, v = flat.reshape(ends.shape)
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        for end in (label[u], label[v], u, v):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b) but the smallest ones; steps alternate until nothing changes,
    which labels that only ever fall must reach."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(labelled, "node long, component long")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = mark
        met = met_with_least(now.union(now.select("v", "u")), 2 * mark[0])
        large = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        pairs = F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = stored(met_with_least(large, 2 * mark[0]).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
