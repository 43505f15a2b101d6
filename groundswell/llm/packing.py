"""Best-fit packing of tokenised documents into sequences of fixed capacity, by linear grouping.

Large pieces (over a third of the capacity) are split by length into groups of equal cardinality, and each length
is rounded up to its group's largest. The few sizes that remain make a configuration program, solved by column
generation; its whole parts say which groups share a sequence. Actual pieces then take the places of their group, and
all other pieces, longest first, go where the least room that holds them is left (best fit), opening sequences only
when none is.

The plan needs the histogram of lengths only, which has as many entries as a sequence has tokens, however many
documents there are. It consists of runs: so many pieces of one length, by rank among their equals, go to consecutive
sequences at one offset. Pieces get their rank in parts, so that a length shared by a third of all pieces is spread.

Defined results: a null text is an empty one; an empty text is a piece of one token, the closing id. Only documents
longer than a sequence are cut, into whole sequences after a first piece that may be shorter. Repeated rows are packed
each for itself; extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stored, table

CAPACITY = 2048
GROUPS = 256
SMALL = 3  # pieces of at most capacity / SMALL tokens are small
END_ID = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALTS = 1 << 16
PART = 1 << 16  # pieces of one length, about, that are ranked in one task

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of a byte-level BPE file of the tokenizers library, without added special tokens.

    The merges run in tiktoken, which gives the same ids several times faster; what it refuses goes to tokenizers.
    """
    if path not in _ENCODERS:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_alphabet()
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        quick = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        slow: list = []

        def encode(text: str) -> np.ndarray:
            try:
                return quick.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:
                if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":  # its regular expression gave up
                    raise
                slow[:] = slow or [Tokenizer.from_file(path)]
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document (doc_id, text): place in the document, length, CRC-32 of its ids, and salt, a number
    that tells equal rows apart often enough to spread them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done = encoder(path), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                out += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = [*(list(zip(*out, strict=True)) or [()] * 5), np.arange(done, done + len(out)) % SALTS]
            done += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", salt long")


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """How often each pattern of sizes fills a sequence: the whole parts of the configuration program's optimum.

    Simplex on patterns, priced by a knapsack over the capacity; it starts from patterns of one size each.
    """
    k = len(sizes)
    size, need = np.array(sizes), np.array(counts, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    places = np.arange(capacity + 1)[None, :] - size[:, None]
    for _ in range(200 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // min(sizes)):
            gains = np.where(places >= 0, best[np.maximum(places, 0)] + price[:, None], -1.0)
            pick = gains.argmax(0)
            gain = gains[pick, np.arange(capacity + 1)]
            better = gain > best + 1e-12
            picks.append(np.where(better, pick, -1))
            best = np.maximum(best, gain)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if (g := pick[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        now, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, now / step, np.inf)
        basis[:, int(ratio.argmin())] = column
    uses = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(uses[j])) for j in range(k) if uses[j] > 0]


@dataclass
class Bins:
    """Sequences filled alike: items are (length, how many in each)."""

    items: list[tuple[int, int]]
    count: int
    room: int


def grouped_bins(histogram: dict[int, int], capacity: int, groups: int) -> list[Bins]:
    """Sequences of large pieces by linear grouping; takes what they hold from the histogram."""
    lengths = sorted((n for n, c in histogram.items() if c and capacity // SMALL < n < capacity), reverse=True)
    total = sum(histogram[n] for n in lengths)
    if not total:
        return []
    pools: list[list[list[int]]] = [[]]  # by group: [length, count], longest first
    held, each = 0, -(-total // groups)
    for n in lengths:  # equal lengths stay in one group: splitting them rounds nothing
        if held >= each * len(pools) and pools[-1]:
            pools.append([])
        pools[-1].append([n, histogram[n]])
        held += histogram[n]
    sizes = [p[0][0] for p in pools]
    out = []
    for pattern, uses in configurations(sizes, [sum(c for _, c in p) for p in pools], capacity):
        slots = [g for g, a in enumerate(pattern) for _ in range(a)]
        runs: list[list[list[int]]] = []  # by slot, the pieces that take it, in order of sequences
        for g in slots:
            need, run = uses, []
            while need and pools[g]:
                take = min(need, pools[g][0][1])
                run.append([pools[g][0][0], take])
                histogram[run[-1][0]] -= take
                need -= take
                pools[g][0][1] -= take
                if not pools[g][0][1]:
                    pools[g].pop(0)
            if run or need:
                runs.append(run + [[0, need]] * bool(need))
        while runs and runs[0]:
            n = min(r[0][1] for r in runs)
            items: dict[int, int] = defaultdict(int)
            for r in runs:
                items[r[0][0]] += 1
                r[0][1] -= n
                if not r[0][1]:
                    r.pop(0)
            items.pop(0, None)
            out.append(Bins(sorted(items.items(), reverse=True), n, capacity - sum(a * b for a, b in items.items())))
    return [b for b in out if b.items]


def best_fit(histogram: dict[int, int], bins: list[Bins], capacity: int) -> list[Bins]:
    """All pieces left, longest first, each where the least room that holds it is left; alike sequences at once."""
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_room[b.room].append(b)
    for n in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[n]
        room = n
        while left and room <= capacity:
            while left and by_room[room]:
                b, per = by_room[room].pop(), room // n
                whole = min(b.count, left // per)
                if whole:
                    by_room[room - per * n].append(Bins([*b.items, (n, per)], whole, room - per * n))
                    left -= whole * per
                if b.count > whole:
                    if 0 < left < per:
                        by_room[room - left * n].append(Bins([*b.items, (n, left)], 1, room - left * n))
                        left, whole = 0, whole + 1
                    if b.count > whole:
                        by_room[room].append(Bins(b.items, b.count - whole, room))
            room += 1
        per = capacity // n
        if left >= per:
            by_room[capacity - per * n].append(Bins([(n, per)], left // per, capacity - per * n))
        if left % per:
            by_room[capacity - left % per * n].append(Bins([(n, left % per)], 1, capacity - left % per * n))
    return [b for row in by_room for b in row]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, pieces in each sequence, offset), by length and rank, and the number of sequences."""
    left = dict(histogram)
    bins = best_fit(left, grouped_bins(left, capacity, groups), capacity)
    rank: dict[int, int] = defaultdict(int)
    runs, base = [], 0
    for b in bins:
        offset = 0
        for n, per in b.items:
            runs.append((n, rank[n], per * b.count, base, per, offset))
            rank[n] += per * b.count
            offset += per * n
        base += b.count
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6), base


def ranked(pieces: DataFrame, count: int) -> DataFrame:
    """pieces (so many) with rank, from 0, among those of the same length: in parts first, then over the parts."""
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("salt"), F.lit(min(SALTS, count // PART + 1))))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    sums = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = sums.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return dealt.withColumn("within", within).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "part", "within", "base")


def packed(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """docs (doc_id, text) as pieces with their sequence_id and offset."""
    pieces = stored(tokenised(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = packing_plan(histogram, capacity, groups)
    # Runs in order of length and rank cover each length without gaps, so one number line places every piece.
    lengths, begins = [], np.cumsum(runs[:, 2]) - runs[:, 2]
    origin = np.zeros(capacity + 1, dtype=np.int64)
    for i, n in enumerate(runs[:, 0].tolist()):
        if n not in lengths[-1:]:
            lengths.append(n)
            origin[n] = begins[i]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (np.asarray(columns[n].to_numpy(zero_copy_only=False), dtype=np.int64) for n in ("length", "rank"))
            at = origin[length] + rank
            run = np.searchsorted(begins, at, side="right") - 1
            k = at - begins[run]
            sequence, offset = runs[run, 3] + k // runs[run, 4], runs[run, 5] + k % runs[run, 4] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked(pieces, sum(histogram.values())).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
