"""The driver's queries over whole tables for the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import contamination
from .hard_negatives import mine
from .hidden_markov import language_scores
from .language_id import identify
from .lexical_search import search
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import quality_verdicts
from .rule_ensemble import quality_scores
from .substring_dedup import remove_repeats
from .token_files import token_table
from .warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("repeats")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hits", "items")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, drawn = mix(_table(spark, sf_dir, "documents"))
    return drawn.select(
        "doc_id", F.col("__tw_source").alias("source"), F.col("__tw_lang").alias("lang"), F.col("__tw_topic").alias("topic"),
        F.col("__tw_tokens").alias("n_tokens"), F.round("__tw_weight", 7).alias("cell_weight"),
        F.round("__tw_probability", 6).alias("probability"), F.col("__tw_sampled").alias("sampled"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_substring_dedup,
        op3_token_files,
        op4_warc,
        op5_quality_classifier,
        op6_hidden_markov,
        op7_decontamination,
        op8_mixing,
        op9_quality_rules,
        op10_language_id,
        op11_hard_negatives,
        op12_ranked_search,
        op13_best_fit_packing,
    )
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": oracles.NEAR_DEDUP,
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op4_warc": oracles.WARC,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op8_mixing": oracles.MIXING,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_ranked_search": oracles.LEXICAL_SEARCH,
}
