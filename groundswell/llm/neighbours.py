"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: each split projects on the difference of two random sample vectors and cuts at
the median. Every row is then routed to one leaf of each tree. A query walks all trees through one priority queue,
nearest cuts first, and takes as many leaves as a trial on the sample asks for: there, so many leaves held the wanted
share of the true neighbours. Vectors in clusters so need few leaves; vectors without structure need many, as for any
index. Within leaves the distances are exact, so the forest decides only who is looked at. Leaves are work units: rows
and queries of a leaf meet in one task, and a leaf of many rows in several.

Equal vectors share all distances, so an index row stands for each distinct vector with its k + 1 smallest ids, which
is all that any result can hold; equal queries are searched once. Both keep results whole when one vector is a third
of all rows.

Defined results: vectors that are null or zero, hold null or non-finite components, or are not of the commonest
length take no part, nor do rows with a null id. A row is never its own neighbour; repeats of an id count once. Extra
columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import joined, stored, table
from .near_dedup import groups

TREES = 4
LEAF_ROWS = 128  # in a leaf of a large index; a small one has finer leaves, down to 8 rows, and up to 2**FINE of them
FINE = 9
MOST_DEPTH = 11
SAMPLE = 32768  # vectors that trees are fitted on: 16 for each of 2**MOST_DEPTH leaves
RECALL = 0.95  # of the neighbours in the sample that a query's leaves must hold
TRIALS = 128  # sample vectors that are searched for to find out how many leaves that takes
BLOCK = 4096  # rows of a leaf that meet queries in one task
EVERY = 100
K = 10


@dataclass
class Forest:
    """normals (trees, inner nodes, size) and cuts; children of node i are 2i+1 and 2i+2; leaves count from 0."""

    normals: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.cuts.shape[1] + 1).bit_length() - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(self.cuts), len(x)), dtype=np.int64)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
            out[t] = node - len(cuts)
        return out

    def search(self, q: np.ndarray, most: int, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves nearest to q in one queue over all trees, by the largest cut distance on the way: as
        many as most, and on until the leaves of one tree, which are disjoint, hold enough rows by sizes (trees, leaves)."""
        inner = self.cuts.shape[1]
        margins = self.normals @ q - self.cuts
        queue, found = [(0.0, t, 0) for t in range(len(self.cuts))], []
        held = [0] * len(self.cuts)
        while queue and (len(found) < most or max(held) < enough):
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near = 2 * node + 1 + int(m > 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * node + 3 - near))
                node = near
            found.append((t, node - inner))
            held[t] += int(sizes[t, node - inner])
        return found


def depth_for(rows: int, sample: int) -> int:
    wanted = max(math.log2(max(2, rows / LEAF_ROWS)), min(FINE, math.log2(max(2, rows / 8))))
    return max(1, min(MOST_DEPTH, round(wanted), int(math.log2(max(2, sample / 8)))))


def fitted(sample: np.ndarray, trees: int, depth: int, seed: int = 17) -> Forest:
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    normals, cuts = np.zeros((trees, 2**depth - 1, size)), np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        members = [np.arange(len(sample))]
        for node in range(2**depth - 1):
            own = members[node]
            pick = rng.choice(own if len(own) > 1 else len(sample), 2, replace=len(sample) < 2)
            normal = sample[pick[0]] - sample[pick[1]]
            if not normal.any():
                normal = rng.normal(size=size)
            normal /= np.linalg.norm(normal)
            along = sample[own] @ normal
            cut = float(np.median(along)) if len(own) else 0.0
            normals[t, node], cuts[t, node] = normal, cut
            members += [own[along <= cut], own[along > cut]]
    return Forest(normals, cuts)


def leaves_wanted(forest: Forest, sample: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> int:
    """How many leaves, nearest first, hold so large a share of the k nearest sample vectors of a sample vector."""
    all_leaves = forest.cuts.size + len(forest.cuts)
    if len(sample) <= k + 1:
        return all_leaves
    where, sizes = forest.leaves(sample), np.zeros((len(forest.cuts), forest.cuts.shape[1] + 1), dtype=np.int64)
    norms, needed = np.einsum("ij,ij->i", sample, sample), []
    for q in np.unique(np.linspace(0, len(sample) - 1, trials).astype(int)):
        far = norms - 2 * sample @ sample[q]
        far[q] = np.inf
        near = np.argpartition(far, k)[:k]
        turn = np.zeros((len(forest.cuts), forest.cuts.shape[1] + 1), dtype=np.int64)
        for i, (t, leaf) in enumerate(forest.search(sample[q], all_leaves, sizes, 0)):
            turn[t, leaf] = i + 1
        needed.append(turn[np.arange(len(forest.cuts))[:, None], where[:, near]].min(0))
    return int(np.quantile(np.concatenate(needed), recall, method="higher"))


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector its k smallest ids, a row each."""
    return rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k).drop("n")


def nearest(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, trees: int = TREES, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of each row whose id is divisible by every."""
    rows = usable(vectors, id_, vector)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    result = "query_id long, rank int, id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], result)
    size = lengths["size"]
    raw_type = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    rows = rows.where(F.size("v") == size)
    index = stored(distinct_vectors(rows, k + 1), "index")
    count = index.count()
    fit_on = np.array([r["v"] for r in index.orderBy(F.xxhash64("id"), "id").select("v").limit(sample).collect()], dtype=np.float64)
    depth = depth_for(count, len(fit_on))
    grown = fitted(fit_on, trees, depth)
    most = max(min(trees, 2), leaves_wanted(grown, fit_on, k, recall))
    forest = vectors.sparkSession.sparkContext.broadcast(grown)  # at most trees * 2**MOST_DEPTH vectors

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), size)

    def leaf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        n = np.zeros(len(f.cuts) << f.depth, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                leaves = f.leaves(matrix(whole.slice(at, 1024).column(1)))
                np.add.at(n, ((np.arange(len(f.cuts)) << f.depth)[:, None] + leaves).ravel(), 1)
        leaf = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n[leaf])], names=["leaf", "n"])

    routed = index.mapInArrow(leaf_counts, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    sizes = np.zeros(trees << depth, dtype=np.int64)
    for r in routed.collect():  # at most trees * 2**MOST_DEPTH rows
        sizes[r["leaf"]] = r["n"]
    sizes = sizes.reshape(trees, -1)
    blocks = np.maximum(1, -(-sizes // block))  # keys: tree, leaf, and block of the leaf's rows
    queries = rows.where(F.col("id") % every == 0)
    asked = queries.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")

    def keyed(kind: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = forest.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
                    if kind:
                        visits = [f.search(q, most, sizes, k + 1) for q in x]
                        seen = np.array([(i, t, leaf) for i, v in enumerate(visits) for t, leaf in v], dtype=np.int64).reshape(-1, 3)
                        times = blocks[seen[:, 1], seen[:, 2]]
                        row, tree, leaf = np.repeat(seen, times, axis=0).T
                        part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    else:
                        row, tree, leaf = np.tile(np.arange(len(x)), len(f.cuts)), np.repeat(np.arange(len(f.cuts)), len(x)), f.leaves(x).ravel()
                        part = ((ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) % blocks[tree, leaf]
                    key = (tree << 56) | (leaf << 40) | part
                    raw = [v.tobytes() for v in x.astype(raw_type)]
                    for lo in range(0, len(row), 8192):
                        some = row[lo : lo + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 8192]), pa.array(np.full(len(some), kind, dtype=np.int32)), pa.array(ids[some]), pa.array([raw[i] for i in some], type=pa.binary())], names=["key", "kind", "id", "v"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for (_, kind, ids, raw), first, _ in groups(batches, 1, 4096):
            if first:
                held = []
            x = np.frombuffer(b"".join(raw), dtype=raw_type).reshape(len(ids), -1).astype(np.float64)
            if (kind == 0).any():
                held.append((ids[kind == 0], x[kind == 0]))
            if (kind == 1).any() and held:
                held = [tuple(np.concatenate(p) for p in zip(*held, strict=True))]
                yield closest(ids[kind == 1], x[kind == 1], *held[0])

    def closest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, ...]] = []
        norms = np.einsum("ij,ij->i", x, x)
        for at in range(0, len(q), 256):
            near = norms - 2 * q[at : at + 256] @ x.T  # for the choice only: exact distances follow
            bound = np.partition(near, min(k, len(ids) - 1), axis=1)[:, min(k, len(ids) - 1)]
            slack = 1e-9 * (1 + np.abs(bound))
            row, col = np.nonzero(near <= (bound + slack)[:, None])
            apart = x[col] - q[at + row]
            out.append((query_ids[at + row], ids[col], np.sqrt(np.einsum("ij,ij->i", apart, apart))))
        a, b, c = (np.concatenate(p) for p in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["asked", "id", "score"])

    schema = "key long, kind int, id long, v binary"
    both = index.mapInArrow(keyed(0), schema).union(asked.mapInArrow(keyed(1), schema))
    pairs = both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(meet, "asked long, id long, score double")
    best = pairs.groupBy("asked", "id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    best = stored(best.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("found")), "best")  # k + 1 a query
    counts = queries.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    who = joined(queries.select(F.col("id").alias("query_id"), "v").distinct(), asked.select("v", F.col("id").alias("asked")), ["v"], counts).select("query_id", "asked")
    met = joined(who, best, ["asked"], who.groupBy("asked").agg(F.count(F.lit(1)).alias("n")))
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.id", "x.score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
ORACLES: dict[str, str] = {}
