"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are words and word pairs, and the same of word shapes (letters, capitals, digits and marks, runs shortened),
hashed to a fixed number of weights; values are square roots of counts, scaled to length one. Training walks over a
sample of labelled documents, at most so many of each label, chosen by a hash of the id; a document's score is the
sparse dot product of its features with the weights. The sample, and hence the driver's work, is bounded; the weights
have a fixed size and ship with the tasks.

Defined results: null and empty texts have no features, so their score is that of the bias. Labels other than 0 and 1,
ids with both labels and documents without a label or an id are not learnt from; of an id's texts the smallest counts.
Repeated rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import parts, table

BITS = 20
SAMPLE = 2000
EPOCHS = 3
REMEMBERED = 300_000
SHAPES = ((re.compile(r"[0-9]+"), "0"), (re.compile(r"[^\W\d_]+"), ""), (re.compile(r"([^\w\s])\1+"), r"\1"))


def shape(word: str) -> str:
    """Letters as a (small) or A (capitals first) or AA (capitals only), digits as 0, runs of a mark once."""
    word = SHAPES[0][0].sub("0", word)
    word = SHAPES[1][0].sub(lambda m: "AA" if len(m[0]) > 1 and m[0].isupper() else "A" if m[0][0].isupper() else "a", word)
    return SHAPES[2][0].sub(r"\1", word)[:16]


class Hasher:
    """Words to 64-bit numbers (word, shape), remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")), zlib.crc32(b"\1" + shape(w).encode("utf-8", "surrogatepass")))
        return np.array([known[w] for w in words], dtype=np.uint64).reshape(-1, 2)

    def features(self, text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and values; index 0 is the bias."""
        n = self.numbers((text or "").split())
        mix = np.uint64(0x9E3779B97F4A7C15)
        pairs = (n[:-1] * mix) ^ (n[1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        same = (n[:-1, 0] == n[1:, 0]).astype(np.uint64) + np.uint64(2)  # whether a word is said twice running
        every = np.concatenate([n[:, 0] * mix, n[:, 1] * mix, pairs[:, 0], pairs[:, 1], same * mix])
        index, counts = np.unique((every >> np.uint64(64 - bits)) | np.uint64(1), return_counts=True)
        value = np.sqrt(counts)
        return np.concatenate(([0], index.astype(np.int64))), np.concatenate(([1.0], 4.0 * value / max(1e-9, np.sqrt((value**2).sum()))))


def train(examples: list[tuple[tuple[np.ndarray, np.ndarray], int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights after follow-the-regularised-leader (proximal) updates, one document at a time, in an order drawn by a fixed seed."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            (i, x), y = examples[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int) -> list[tuple[str, int]]:
    """At most `most` texts of each label, from documents that may be learnt from, those of the smallest hashes of their ids.
    An id with both labels is left out; of an id's texts the smallest counts, so that no id brings more than one."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & may_learn & F.col("y").isin(0, 1))
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("id", "y")
    zeros, ones = (usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1))
    met = docs.select("doc_id", "text").join(F.broadcast(zeros.union(ones)), F.col("doc_id") == F.col("id"))  # at most 2 * most ids
    rows = met.groupBy("id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()  # a row an id
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["id"])]


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs (doc_id, text) as doc_id, score."""
    bits = len(weights).bit_length() - 1
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = shipped.value, Hasher()
        for batch in batches:
            out = []
            for texts in parts(batch.column(1)):
                for text in texts:
                    i, x = hasher.features(text, bits)
                    out.append(float(1 / (1 + np.exp(-np.clip(w[i] @ x, -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def fit(examples: Iterable[tuple[str, int]]) -> np.ndarray:
    hasher = Hasher()
    return train([(hasher.features(t), y) for t, y in examples])


def op7_quality_classifier(spark: SparkSession, sf_dir: str, sample: int = SAMPLE) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", ~in_fold(F.col("id"), 5, 0), sample))
    return scored(docs, weights).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
