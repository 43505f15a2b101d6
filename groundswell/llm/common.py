"""What the operators of this subpackage share: tables, shared folders, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.tables import shared_dir, stored

#: Characters that end a word, as a regular expression.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def words_of(text: Column) -> Column:
    """The words of a text (maximal runs without white space); none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: A key that more than one in so many rows have is hot; there are fewer such keys than this.
HOT = 1000


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, which has a row a key at most, where no task gets all rows of a hot key.

    counts: keys and n, how many rows have the key (keys of few rows may be left out). Facts of hot keys, at most HOT
    rows, are broadcast; all others are joined by a shuffle, where a key has at most one in HOT rows.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [tuple(r) for r in counts.where(F.col("n") > max(total / HOT, 10_000)).select(*keys).collect()]  # at most HOT rows
    if not hot:
        return rows.join(facts, keys, how)
    named = F.broadcast(rows.sparkSession.createDataFrame(hot, counts.select(*keys).schema))
    few = F.broadcast(facts.join(named, keys, "left_semi"))
    return rows.join(named, keys, "left_semi").join(few, keys, how).unionByName(rows.join(named, keys, "left_anti").join(facts, keys, how))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def parts(texts: pa.Array, chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts of a column in lists of some megabytes at most, a longer text alone, so that work on words stays small."""
    held, size = [], 0
    for value in texts:
        text = value.as_py()
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


__all__ = ["HOT", "SPACES", "joined", "let", "parts", "scratch_path", "shared_dir", "stored", "table", "unused", "words_of"]
