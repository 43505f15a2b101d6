"""Mixing sources to target weights.

The words of each source are packed, document after document, into blocks of fixed length. Each output shard draws
its counts of slots by source from a multinomial over what the targets still lack, so that all draws together meet
the targets. A source's slots are numbered shard after shard; slot j of pass p takes the block that a pseudorandom
permutation of the source's block indexes gives for j, and slots and documents join on block indexes. So the draws say
which shard a block goes to: `mixed_blocks` is the mix, shard by shard and slot by slot.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a target
stops at twice its source's words and the excess is shared again by weight. So a block is taken twice at most.

Nothing here depends on how many partitions Spark uses: starts are running sums over parts of a source whose number
follows from the number of rows, and draws come from fixed seeds. Sources may be many: they stay in a table, and draws
are made for GROUP sources at a time, first between the groups. The driver holds one number a group and shard.

Defined results: a null text has no words; documents without words are in no block and are taken 0 times; repeated
rows are documents of their own. A source shorter than 64 blocks uses shorter blocks, so that its last words can be
met as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import joined, let, stored, table, unused, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 128
SHARDS = 64
ROUNDS = 12
SEED = 7
GROUP = 1024  # sources that draw together
PART = 1 << 14  # rows, about, whose starts are summed in one task
CHUNK = 1 << 16  # slots, or repeats of a row, that are written out from one row


# --- sources and targets ------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 0: within ranges, then over the ranges."""
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), name)
    sums = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    bases = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__own", within).join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__own")).drop("__part", "__base", "__own")


def with_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (n, weight, ...) with target: share of all sizes, dealt by weight; none above most times its size, whose excess is
    dealt again. The level only rises, and each round that raises it fills another source, so the rounds end."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    level, filled = 0.0, -1
    full = lambda level: (F.col("n") == 0) | (F.lit(level) * F.col("weight") > most * F.col("n"))
    while True:
        s = sizes.agg(F.count_if(full(level)).alias("full"), F.sum(F.when(full(level), most * F.col("n"))).alias("taken"), F.sum(F.when(~full(level), F.col("weight"))).alias("weights")).first()
        if s["full"] == filled or not s["weights"]:
            return sizes.withColumn("target", F.when(full(level), (most * F.col("n")).cast("double")).otherwise(F.lit(level) * F.col("weight")))
        level, filled = (share * total - (s["taken"] or 0)) / s["weights"], s["full"]


def planned_sources(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source, numbered in code-point order, null last: src, source, n (words), target, blk (block length),
    blocks, and slots: as many as come nearest to the target, whole passes first, then blocks for the rest."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sums, order, "src").withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")))
    aimed = with_targets(stored(ranked, "sources"))
    blk = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("n") / 64))).cast("long")
    out = aimed.withColumn("blk", blk).withColumn("blocks", F.ceil(F.col("n") / F.col("blk")))
    passes = F.when(F.col("n") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.greatest(F.col("n"), F.lit(1))))).otherwise(F.lit(0)).cast("long")
    rest = F.least(F.col("blocks"), F.round((F.col("target") - passes * F.col("n")) / F.col("blk")).cast("long"))
    slots = F.when(F.col("n") > 0, F.least(MOST * F.col("blocks"), passes * F.col("blocks") + rest)).otherwise(F.lit(0).cast("long"))
    return stored(out.withColumn("slots", slots).drop("weight"), "planned")


# --- draws --------------------------------------------------------------------------------------------------------


def shard_counts(slots: np.ndarray, needs: np.ndarray, seed: list[int]) -> np.ndarray:
    """Slots by shard and source. Each shard draws what it needs from a multinomial over what is left; draws beyond that are
    drawn again."""
    left, rng = np.array(slots, dtype=np.int64), np.random.default_rng(seed)
    out = np.zeros((len(needs), len(left)), dtype=np.int64)
    for k, need in enumerate(needs.tolist()):
        while need:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[k] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def even_needs(total: int, shards: int) -> np.ndarray:
    at = [total * k // shards for k in range(shards + 1)]
    return np.diff(np.array(at, dtype=np.int64))


def drawn_runs(sources: DataFrame, shards: int = SHARDS, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """shard, src, first, n: how many slots of each source a shard draws, and the first of them among the source's."""
    grouped = sources.withColumn("grp", F.floor(F.col("src") / group))
    totals = sorted((r["grp"], r["slots"]) for r in grouped.groupBy("grp").agg(F.sum("slots").alias("slots")).collect())  # a row a group
    between = shard_counts(np.array([n for _, n in totals]), even_needs(sum(n for _, n in totals), shards), [seed])
    needs = {g: between[:, i] for i, (g, _) in enumerate(totals)}

    def draw(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("src")
        counts = shard_counts(rows.column("slots").to_numpy(), needs[key[0].as_py()], [seed, key[0].as_py()])
        first = np.cumsum(counts, axis=0) - counts
        shard, at = np.nonzero(counts)
        return pa.table({"shard": pa.array(shard, type=pa.int32()), "src": pa.array(rows.column("src").to_numpy()[at]), "first": pa.array(first[shard, at]), "n": pa.array(counts[shard, at])})

    return grouped.select("grp", "src", "slots").groupBy("grp").applyInArrow(draw, "shard int, src long, first long, n long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A bijection of 0..n-1 chosen by key: rounds that each swap an index with its partner, or not, by a hash of both."""

    def round_(a: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) + n - a, n)
        return let(partner, lambda b: F.when(F.pmod(F.xxhash64(F.greatest(a, b), r, *key), F.lit(2)) == 0, a).otherwise(b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, round_)


def spread(rows: DataFrame, n: str, place: str, *by: str) -> DataFrame:
    """Each row n times over, with place from 0 to n - 1: in chunks, which are dealt before they are written out."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK)))).repartition(parts, *by, "__chunk")
    lo = F.col("__chunk") * CHUNK
    return chunks.withColumn(place, F.explode(F.sequence(lo, F.least(lo + CHUNK, F.col(n)) - 1))).drop("__chunk")


def taken_blocks(sources: DataFrame, shards: int = SHARDS, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """A row for each slot: shard, slot, src, block. Joins with it ask for a shuffle: Spark would judge its size by that of the
    runs, and broadcast it."""
    runs = stored(drawn_runs(sources, shards, seed, group).join(sources.select("src", "blocks"), "src"), "runs")
    slots = spread(runs, "n", "__at", "src", "shard").withColumn("slot", F.col("first") + F.col("__at"))
    pass_ = F.floor(F.col("slot") / F.col("blocks"))
    return slots.select("shard", "slot", "src", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("src"), pass_).alias("block"))


# --- documents ----------------------------------------------------------------------------------------------------


def identity(docs: DataFrame) -> list[Column]:
    """Two hashes of a row; rows that agree in both are equal."""
    kinds = [c for c, t in docs.dtypes if "map<" not in t]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in kinds]), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in reversed(kinds)])]


def measured(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, source, size of each different row, and copies: how often it is there."""
    size = F.size(words_of(F.col("text"))).cast("long").alias("size")
    k1, k2 = identity(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "source", size)
    return stored(rows.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each document, copies among them: k1, k2, doc_id, size, copy, src, blk, source_size, target, and start, its first
    word's place in its source. Starts are running sums, first within hashed parts of a source and then over the parts."""
    rows = sized.count()
    named = lambda df: df.withColumns({"none": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    facts = named(sources).select("none", "source", "src", F.col("n").alias("source_size"), "target", "blk")
    some = named(sized)
    met = joined(some, facts, ["none", "source"], some.groupBy("none", "source").agg(F.count(F.lit(1)).alias("n")))
    dealt = met.drop("none", "source").withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.lit(rows // PART + 1)))
    words = F.col("size") * F.col("copies")
    before = F.sum(words).over(Window.partitionBy("src", "part").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)) - words
    sums = dealt.groupBy("src", "part").agg(F.sum(words).alias("n"))
    bases = sums.select("src", "part", (F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    first = stored(dealt.withColumn("before", before).join(bases, ["src", "part"]).withColumn("first", F.col("base") + F.col("before")).drop("part", "base", "before"), "first")
    again = first.where("copies > 1")
    out = first.where("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    if not again.isEmpty():
        out = out.unionByName(spread(again, "copies", "copy", "k1", "k2"))
    return out.withColumn("start", F.col("first") + F.col("copy") * F.col("size")).drop("first", "copies")


def pieces(place: DataFrame) -> DataFrame:
    """Documents with words, cut at block ends: each row gets block, from_word and n_words."""
    cut = place.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("blk")), F.floor((F.col("start") + F.col("size") - 1) / F.col("blk")))))
    lo = F.greatest(F.col("start"), F.col("block") * F.col("blk"))
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("blk"))
    return cut.withColumns({"from_word": lo - F.col("start"), "n_words": hi - lo})


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and placed documents."""
    sized = measured(docs)
    sources = planned_sources(sized.withColumn("size", F.col("size") * F.col("copies")))
    return sources, stored(placed(sized, sources), "placed")


def mixed_blocks(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: shard, src, slot, block, and what lies in the block: doc_id, copy, from_word, n_words; one row for each piece of a
    document. Words of a shard are those of its rows."""
    sources, place = plan(docs)
    met = pieces(place).join(taken_blocks(sources, shards, seed).hint("merge"), ["src", "block"])
    return met.select("shard", "src", "slot", "block", "doc_id", "k1", "k2", "copy", "from_word", "n_words")


def mix_counts(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted; and shards: those
    that hold any of its words."""
    sources, place = plan(docs)
    met = pieces(place).join(taken_blocks(sources, shards, seed).hint("merge"), ["src", "block"])
    keys = ["k1", "k2", "copy"]
    some = met.groupBy(*keys).agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    out = place.join(some, keys, "left").withColumns({"taken": F.coalesce("taken", F.lit(0).cast("long")), "shards": F.coalesce("shards", F.array().cast("array<int>"))})
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each pass over a document, with what that pass takes of it, under its id.

    A pass that takes all of a document keeps its text as it is; else the words taken are joined by single spaces.
    """
    sources, place = plan(docs)
    times = taken_blocks(sources, shards, seed).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    met = pieces(place).join(times.hint("merge"), ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
    cut = F.struct("from_word", "n_words", "times")
    names = {c: unused(docs, c) for c in ("k1", "k2", "cuts", "made")}
    cuts = met.groupBy("k1", "k2", "copy").agg(F.sort_array(F.collect_list(cut)).alias("cuts")).where(F.exists("cuts", lambda c: c["times"] > 0))
    keys = [names["k1"], names["k2"]]
    cuts = cuts.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("cuts").alias(names["cuts"]))
    k1, k2 = identity(docs)
    rows = docs.withColumns({keys[0]: k1, keys[1]: k2})
    again = place.where("copy = 1").select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1])).distinct()
    if not again.isEmpty():  # of rows that repeat one stands for all: their cuts have as many rows
        few = stored(place.groupBy(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1])).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
        rows = rows.join(few, keys, "left_anti").unionByName(joined(rows, few.drop("n"), keys, few).dropDuplicates(keys))
    found, chosen_text = F.col(names["cuts"]), F.col("text")

    def of_pass(p: int) -> Column:
        chosen = F.filter(found, lambda c: c["times"] >= p)
        some = let(words_of(chosen_text), lambda w: F.array_join(F.flatten(F.transform(chosen, lambda c: F.slice(w, (c["from_word"] + 1).cast("int"), c["n_words"].cast("int")))), " "))
        return F.when(F.size(chosen) == 0, F.lit(None)).when(F.size(chosen) == F.size(found), chosen_text).otherwise(some)

    made = F.col(names["made"])
    out = rows.join(cuts, keys).withColumn(names["made"], F.explode(F.array(*[of_pass(p + 1) for p in range(MOST)]))).where(made.isNotNull()).withColumn("text", made)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
