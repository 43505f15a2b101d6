"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, near_dedup, neighbours, packing, quality_model, quality_rules, secrets, token_counts, toxicity, warc

MODULES = [packing, secrets, near_dedup, token_counts, toxicity, neighbours, quality_model, quality_rules, warc, mixing]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": pipeline}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
