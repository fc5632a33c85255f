"""A corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import stages
from tidewheel.llm.runtime import scope, stored

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("token_output", stages.token_output),
]
#: SQL has no isolation forest, so there is none; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope():  # what the stage stored for itself goes once its rows are written
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return docs
