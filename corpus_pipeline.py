"""From raw documents to packed training sequences, in five stages.

Each stage gets all rows that the one before kept, as a table read again, and returns a DataFrame:

1. quality_rules drops documents that a rule rejects;
2. near_dedup keeps one document (the smallest id, null last) of each group linked by exact copies of the word sequence
   or by five-word shingles of Jaccard similarity 0.8 or more;
3. secret_scans replaces secrets in texts by a mark; it drops no document;
4. mixing repeats, trims or keeps documents so that sources meet their target weights; a document that is taken twice
   has two rows, under its id;
5. packing tokenises and packs; its rows are pieces with their sequence and offset.

Stages 1 to 4 return the columns of documents, n_chars brought up to date where texts change. Nulls, empty texts,
repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundswell.llm import mixing, near_dedup, packing, quality_rules, secrets
from groundswell.llm.common import stored, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = unused(docs, "rejected_by")
    return quality_rules.quality_rules(docs, verdict=verdict).where(F.col(verdict).isNull()).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
