"""SimHash near-deduplication with BK-trees over shards, and the components of its links.

Every distinct fingerprint is dealt to shards such that fingerprints within the radius meet in at least one. Each
shard grows a BK-tree, children keyed by their Hamming distance to the parent; a fingerprint searches the tree of
those before it along the edges within the radius of its own distance, then joins the tree. A shard emits a spanning
forest of its links, so copies never make all their pairs. Trees travel to their shard's task by shuffle; no tree of
the whole corpus exists, and nothing that grows with it is broadcast.

`links` (for the fixed 64-bit contract) shards by agreeing bits: fingerprints that differ in at most two bits agree
on at least one of three blocks of 21 or 22 bits, hence three shards each. A shard above a fixed size deals its
members again, by three parts of the bits that are still free, until a shard is small or has so few free bits that it
cannot hold more than 2**WHOLE fingerprints. No link is lost.

`near_duplicates` (5-word shingles, Jaccard 0.8) shards texts by bands of min-hashes. The trees of a shard find what
lies within a wide radius of a text's SimHash, and exact shingle sets decide every link, in the shard's own task; a
pair is passed over only where its texts are joined already. A shard above a fixed size is split at random, each band
in its own way, which joins what is much alike. Of such a shard only the members outside its largest component are left
to compare: where they are few they meet all of the shard in blocks; where they are many the shard is dealt again by
further min-hashes, and after the last of those they meet in blocks too. No size of a shard drops a member; being
dealt again costs a pair as much recall as the first bands do.

Defined results: a null text is an empty one, with fingerprint zero; empty texts are copies of each other. Documents
with a null id take part like others and link what they are near to; the id of a group is the smallest that it
holds, null if none. Repeated rows are exact copies. One id with different texts is several documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graph import components
from .common import joined, stored, table, unused

SEED = 42
RADIUS = 2
SHARD = 1024
WHOLE = 12  # free bits of a shard that is never dealt again
BANDS, ROWS = 8, 3
LEVELS = 5  # of bands, each of min-hashes of its own
WIDE = 20
SIMILARITY = 0.8


# --- fingerprints -----------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the ASCII-lower-cased text, repeats included; of the whole if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Each bit is set if over half of the hashes set it; a signed 64-bit number."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs (doc_id, text) as doc_id, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, type=pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# --- trees ------------------------------------------------------------------------------------------------------


class BKTree:
    """Numbers of 64 bits under Hamming distance; each child hangs on its parent under their distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(index, distance) of those within the radius."""
        found = []
        values, children = self.values, self.children
        stack = [0] if values else []
        while stack:
            i = stack.pop()
            d = (value ^ values[i]).bit_count()
            if d <= radius:
                found.append((i, d))
            edges = children[i]
            if len(edges) <= 2 * radius:
                stack += [j for e, j in edges.items() if d - radius <= e <= d + radius]
            else:
                stack += [edges[e] for e in range(max(0, d - radius), d + radius + 1) if e in edges]
        return found

    def put(self, value: int) -> None:
        values, children, at = self.values, self.children, 0
        while values:
            d = (value ^ values[at]).bit_count()
            if d not in children[at]:
                children[at][d] = len(values)
                break
            at = children[at][d]
        values.append(value)
        children.append({})

    def add(self, value: int, radius: int) -> list[tuple[int, int]]:
        """near, of those that were added before; then puts value."""
        found = self.near(value, radius)
        self.put(value)
        return found


class Union:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_binary(column.type):
        out = np.empty(len(column), dtype=object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def groups(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Runs of rows with equal keys (the first columns, sorted), as columns, at most limit rows at once: rows, whether
    they begin and whether they end their run. Runs of one row are left out."""
    held: list[np.ndarray] | None = None
    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [numbers(c) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        change = np.zeros(len(held[0]) - 1, dtype=bool)
        for c in held[:keys]:
            change |= c[1:] != c[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [len(held[0])]))
        sizes = np.diff(bounds)
        for g in np.flatnonzero((sizes > 1) | (begun & (np.arange(len(sizes)) == 0))):
            last_run = g == len(sizes) - 1
            lo, hi = int(bounds[g]), int(bounds[g + 1])
            while hi - lo > limit or (not last_run and hi > lo):
                end = min(hi, lo + limit)
                yield [c[lo:end] for c in held], not begun, end == hi and not last_run
                begun, lo = not (end == hi and not last_run), end
            bounds[g] = lo
        held = [c[int(bounds[-2]) :] for c in held]
    if held is not None and (len(held[0]) > 1 or begun):
        yield held, not begun, True


# --- links of fingerprints within two bits -----------------------------------------------------------------------


def mask(bits: range | list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def free(m: int) -> list[int]:
    return [b for b in range(64) if not m >> b & 1]


def first_masks() -> list[int]:
    """Three blocks of bits; two differing bits leave one alone."""
    return [mask(range(0, 22)), mask(range(22, 43)), mask(range(43, 64))]


def narrower(m: int) -> list[int]:
    """m and one of three parts of the bits outside it, each: two differing bits leave one part alone."""
    left = free(m)
    third = -(-len(left) // 3)
    own = [b for b in range(64) if m >> b & 1]
    return [mask(own + left[k : k + third]) for k in range(0, len(left), third)]


def dealt(nodes: DataFrame, masks: Column) -> DataFrame:
    """nodes (fp) in the order of shards: mask, value, fp."""
    rows = nodes.withColumn("mask", F.explode(masks)).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    return rows.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b: fingerprints) that span the components of nodes (fp: distinct) within the radius, which is 2 at most."""
    if not 0 <= radius <= 2:
        raise ValueError("shards bring fingerprints of at most two differing bits together")
    found: list[DataFrame] = []
    masks = first_masks()
    rows = dealt(nodes, F.array(*map(F.lit, masks)))
    while True:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("mask", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
            for (m, _, fp), first, end in groups(batches, 2, 1 << WHOLE):
                if first and end and (len(fp) <= shard or len(free(int(m[0]))) <= WHOLE):
                    tree, union = BKTree(), Union(len(fp))
                    for i, value in enumerate(fp.astype(np.uint64).tolist()):
                        for j, _ in tree.add(value, radius):
                            union.join(i, j)
                    pairs = [(r, i) for i in range(len(fp)) if (r := union.root(i)) != i]
                    out = [m[: len(pairs)], *(fp[[p[k] for p in pairs]] for k in (0, 1))] if pairs else [[], [], []]
                else:  # too large a shard: its members are dealt again
                    out = [m, fp, [None] * len(fp)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

        done = stored(rows.mapInArrow(search, "mask long, a long, b long"), "links")
        found.append(done.where("b IS NOT NULL").select("a", "b"))
        again = done.where("b IS NULL").select("mask", F.col("a").alias("fp"))
        if again.isEmpty():
            break
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*map(F.lit, narrower(m))))])
        rows = dealt(again, F.element_at(finer, F.col("mask")))
        masks = sorted({n for m in masks for n in narrower(m)})
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


# --- components --------------------------------------------------------------------------------------------------


def smallest(nodes: DataFrame, linked: DataFrame, rank: Column) -> DataFrame:
    """nodes (node, ...) with the component of each and, as least, the smallest rank in it."""
    named = stored(nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    groups_ = named.groupBy("component").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n"))
    return joined(named, groups_.drop("n"), ["component"], groups_.select("component", "n"))


def fingerprint_components(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text) as doc_id, fp, component_id."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "nodes")
    linked = components(links(nodes.select(F.col("node").alias("fp")), radius))
    named = smallest(nodes, linked, F.col("doc_id")).select(F.col("node").alias("fp"), F.col("least").alias("component_id"))
    return joined(fps, named, ["fp"], nodes.select(F.col("node").alias("fp"), "n")).select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity -------------------------------------------------------------------------------

#: A row's identity: two hashes of its id and text.
KEYS = ["k1", "k2"]
LINKS = "a long, b long"


def permutations(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of a level's min-hashes, BANDS * ROWS of them."""
    rng = np.random.default_rng([2024, level])
    draw = lambda: rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def bands_of(hashes: np.ndarray, level: int = 0) -> list[int]:
    """A number for each band: of the min-hashes of a set of hashes under fixed multiply-add permutations."""
    a, b = permutations(level)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * a + b
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), level * BANDS + k) - (1 << 63) for k in range(BANDS)]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    return docs.withColumns({keys[0]: F.xxhash64(doc_id, text), keys[1]: F.xxhash64(F.lit(1), text, doc_id)})


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """k1, k2, doc_id, copy (a hash of the word sequence), fp and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(3):
                h = shingle_hashes(text.as_py(), words)
                once = np.unique(h)  # of sets, as the similarity is: repeats of a phrase move nothing
                out.append((xxhash.xxh128_digest(h.tobytes()), simhash(once), bands_of(once)))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True))], names=[*KEYS, "doc_id", "copy", "fp", "bands"])

    rows = keyed(docs.select(F.col("doc_id").cast("long"), "text")).select(*KEYS, "doc_id", "text")
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, copy binary, fp long, bands array<long>")


def spanning(fp: np.ndarray, node: np.ndarray, sets: list[np.ndarray], group: np.ndarray, similarity: float, known: int = 0) -> list[tuple[int, int]]:
    """Links of the similarity by exact sets, as many as join what they connect: of rows found through one tree, in order of
    distance, with those before. Rows of one group are joined already; the first `known` rows are only searched for."""
    tree, out = BKTree(), []
    group, size = group.copy(), np.array([len(x) for x in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    present = np.zeros(int(size.sum()) + 1, dtype=bool)
    for i, value in enumerate(fp.astype(np.uint64).tolist()):
        if i >= known and (near := sorted(tree.near(value, WIDE), key=lambda x: x[1])):
            rows = np.array([j for j, _ in near])
            rows = rows[(group[rows] != group[i]) & (np.minimum(size[rows], size[i]) >= similarity * np.maximum(size[rows], size[i]))]
            present[codes[i]] = True
            for j in rows.tolist():
                if group[j] != group[i]:
                    both = int(np.count_nonzero(present[codes[j]]))
                    if both >= similarity * (size[i] + size[j] - both):
                        out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                        group[group == group[j]] = group[i]
            present[codes[i]] = False
        tree.put(value)
    return out


def searched(rows: DataFrame, keys: list[str], limit: int, similarity: float) -> DataFrame:
    """Links (a, b) within shards: rows (keys, asks, fp, node, component, shingles), asks 0 for rows that are only searched for.
    A shard above the limit raises: it is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, first, end in groups(batches, len(keys), limit):
            if not (first and end):
                raise RuntimeError(f"a shard of near duplicates holds more than {limit} texts")
            asks, fp, node, group, raw = columns[len(keys) :]
            pairs = spanning(fp, node, [np.frombuffer(v, dtype="<u8") for v in raw], group, similarity, int((asks == 0).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

    names = [*keys, "asks", "fp"]
    return rows.select(*names, "node", "component", "shingles").repartition(*keys).sortWithinPartitions(*names, "node").mapInArrow(run, LINKS)


def shard_links(rows: DataFrame, shard: int, similarity: float) -> DataFrame:
    """Links within shards: rows (key, n, ...) of one key, or of one random part of a crowded key."""
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / shard))
    return searched(rows.withColumns({"part": part, "asks": F.lit(1)}), ["key", "part"], 16 * shard, similarity)


def block_links(crowded: DataFrame, shard: int, similarity: float) -> DataFrame:
    """Links of crowded rows (key, n, others, outside: bool, ...) that lie outside their key's largest component, with all rows
    of the key: blocks of the ones meet blocks of the others."""
    blocks = lambda n: F.ceil(F.col(n) / shard)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("node", "key", F.lit(salt)), blocks(n))
    rest = ["fp", "node", "component", "shingles"]
    known = crowded.select("key", every("others").alias("p"), own("n", 1).alias("q"), F.lit(0).alias("asks"), *rest)
    asking = crowded.where("outside").select("key", own("others", 2).alias("p"), every("n").alias("q"), F.lit(1).alias("asks"), *rest)
    return searched(known.union(asking), ["key", "p", "q"], 32 * shard, similarity)


def finer(rows: DataFrame, level: int) -> DataFrame:
    """rows (key, node, shingles) as key, node under the bands of this level's own min-hashes, each within its old key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [bands_of(np.frombuffer(v.as_py(), dtype="<u8"), level) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, type=pa.list_(pa.int64()))], names=["key", "node", "bands"])

    again = rows.select("key", "node", "shingles").mapInArrow(run, "key long, node long, bands array<long>")
    return again.select("key", "node", F.posexplode("bands").alias("band", "own")).select(F.xxhash64("key", "band", "own").alias("key"), "node")


def shingle_sets(ends: DataFrame, docs: DataFrame, words: int, counts: DataFrame) -> DataFrame:
    """node, fp, shingles: the sets of the texts that ends (k1, k2, node, fp) names; counts: k1, k2, n of repeated rows."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(shingle_hashes(t.as_py(), words)).astype("<u8").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, type=pa.binary())], names=["node", "fp", "shingles"])

    texts = keyed(docs.select(F.col("doc_id").cast("long"), "text")).select(*KEYS, "text")
    met = joined(texts, ends, KEYS, counts).select("node", "fp", "text")
    if not counts.isEmpty():
        met = met.dropDuplicates(["node"])
    return met.mapInArrow(sets, "node long, fp long, shingles binary")


def shards_of(rows: DataFrame) -> DataFrame:
    """key, n of the keys that several of rows (key, node) have; of keys with the same members, one."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (0, 1)]
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    return several.groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key", "n")


def node_links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float, shard: int, counts: DataFrame) -> DataFrame:
    """node, component of nodes (node, k1, k2, fp, bands) that have links."""
    links_: DataFrame | None = None
    linked = nodes.sparkSession.createDataFrame([], "node long, component long")
    rows = nodes.select(F.posexplode("bands").alias("band", "own"), "node").select(F.xxhash64("band", "own").alias("key"), "node")
    for level in range(LEVELS):
        shards = stored(shards_of(rows), "shards")
        members = stored(joined(rows, shards, ["key"], shards), "members")
        if members.isEmpty():
            break
        ends = nodes.select(*KEYS, "node", "fp").join(members.select("node").distinct(), "node", "left_semi")
        sets = stored(shingle_sets(ends, docs, words, counts), "shingles")

        def full(some: DataFrame, sets: DataFrame = sets) -> DataFrame:
            return some.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sets, "node")

        def add(more: DataFrame) -> tuple[DataFrame, DataFrame]:
            more = stored(more, "similar")
            every = more if links_ is None else links_.union(more)
            return every, components(every)

        links_, linked = add(shard_links(full(members), shard, similarity))
        crowded = members.where(F.col("n") > shard)
        if crowded.isEmpty():
            break
        crowded = stored(crowded.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "crowded")
        sizes = crowded.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).groupBy("key").agg(F.first("n").alias("n"), F.max(F.struct("c", "component")).alias("most"))
        sizes = sizes.select("key", "n", (F.col("n") - F.col("most.c")).alias("others"), F.col("most.component").alias("largest")).where("others > 0")
        sizes = stored(sizes, "crowds")
        if sizes.isEmpty():
            break
        left = joined(crowded.select("key", "node", "component"), sizes, ["key"], sizes).withColumn("outside", F.col("component") != F.col("largest"))
        left = stored(left.join(sets, "node"), "left")
        last = level == LEVELS - 1
        links_, linked = add(block_links(left if last else left.where(F.col("others") <= shard), shard, similarity))
        if last:
            break
        rows = stored(finer(left.where(F.col("others") > shard), level + 1), "finer")
        if rows.isEmpty():
            break
    return linked


def grouped(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (k1, k2, doc_id, copy), groups (copy, n, first: of the row that stays), and k1, k2, n of rows that repeat."""
    made = stored(sketches(docs, words), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEYS)
    first = F.min(F.struct(rank.alias("rank"), "fp", "bands")).alias("s")
    nodes = made.groupBy("copy").agg(first, F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "copy", "n", "s.rank", *[F.col(f"s.rank.{k}").alias(k) for k in KEYS], "s.fp", "s.bands"), "nodes")
    counts = stored(made.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
    linked = node_links(nodes, docs, words, similarity, shard, counts)
    return made.select(*KEYS, "doc_id", "copy"), smallest(nodes.select("node", "copy", "n", "rank"), linked, F.col("rank")).select("copy", "n", F.col("least").alias("first")), counts


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """doc_id, component_id: exact copies of word sequences, and links of the similarity or more, joined."""
    rows, copies, _ = grouped(docs, words, similarity, shard)
    return joined(rows, copies.select("copy", "first"), ["copy"], copies.select("copy", "n")).select("doc_id", F.col("first.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, shard: int = SHARD) -> DataFrame:
    """docs with one row of each group: that with the smallest id (null last), of its texts that of the smallest hash."""
    _, copies, counts = grouped(docs, words, similarity, shard)
    stay = stored(copies.select(*[F.col(f"first.{k}").alias(k) for k in KEYS]).distinct(), "stay")
    names = tuple(unused(docs, k) for k in KEYS)
    own = dict(zip(KEYS, names, strict=True))
    stay, counts = stay.withColumnsRenamed(own), counts.withColumnsRenamed(own)
    ids = unused(docs, "id")
    met = joined(keyed(docs.withColumn(ids, F.col("doc_id").cast("long")), ids, "text", names), stay, list(names), counts)
    if counts.isEmpty():
        return met.select(docs.columns)
    again = met.join(counts.select(*names), list(names), "left_semi").dropDuplicates(list(names))
    return met.join(counts.select(*names), list(names), "left_anti").select(docs.columns).union(again.select(docs.columns))


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
