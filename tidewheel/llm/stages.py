"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame with the columns of ``docs``.

Filtering stages judge each row by its own text, known by its SHA-256 or, between near duplicates, by a row number, so null ids and
ids with several texts are judged like any other. Null and empty texts are too short for the quality rules; the later stages alone would keep them.
Other columns are carried along, whatever their names. An empty table gives an empty one. The last stage returns what the
token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .mixing import mix
from .near_dedup import near_duplicates
from .quality_rules import quality_verdicts
from .queries import tokenizer_path
from .runtime import DIGEST, ROW, keep_ids, numbered, scope, stored
from .token_files import token_table

#: Share of the tokens that mixing keeps.
MIX_FRACTION = 0.9
#: Bytes of text that are encoded at a time, in executors that still hold what earlier stages needed.
TOKEN_BLOCK = 4 << 20
#: Words in a shingle of near duplicates; the two words of ``op1_near_dedup`` are that query's own contract.
NEAR_WIDTH = 5


def _by_text(docs: DataFrame) -> DataFrame:
    """``docs`` with a 64-bit hash of the text in ``ROW``: verdicts on texts need no stored copy of the rows."""
    return docs.withColumn(ROW, F.xxhash64("text"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose text is none of ``gone(doc_id, DIGEST)``: few share a hash with these, and only equal texts their SHA-256 as well.

    Null texts are told from others by their hash and an empty digest.
    """
    told = rows.withColumn(DIGEST, F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    return keep_ids(told, [ROW, DIGEST], gone.select("doc_id", F.coalesce(DIGEST, F.lit(b""))), "left_anti").drop(ROW, DIGEST)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the fixed rules nor the isolation forest reject; null, empty and short texts go, repeated rows stay.

    A label counts for every row of its id; a very long text is held whole in its task.
    """
    with scope():
        rows = _by_text(docs)
        # The operator learns and answers by the text's key; labels are few, so they take those keys.
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        known = labels.withColumnRenamed("doc_id", "__tw_doc").join(rows.select("doc_id", ROW), F.col("__tw_doc") == F.col("doc_id"))
        verdicts = quality_verdicts(rows.select(ROW, "text"), known.select(F.col(ROW).alias("doc_id"), "quality"), id_col=ROW, digest=True)
        gone = stored(verdicts.filter("not kept").select("doc_id", DIGEST), "rejected", keep=True)
    return _without(rows, gone)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, repeated rows included: that with the smallest doc_id (null last).

    Null and wordless texts are near nothing and stay. Between rows of the same smallest id the first in the table stays.
    """
    with scope():
        rows = numbered(docs, keep=True)
        found = near_duplicates(rows.select(ROW, "text"), width=NEAR_WIDTH, id_col=ROW)
        found = stored(found.select(F.col("doc_id").alias("row"), "component_id"), "near")
        # A component of one row needs nothing; the others are few columns wide.
        groups = stored(found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id"), "near-groups")
        members = keep_ids(found, "component_id", groups, ready=False).join(rows.select(ROW, F.col("doc_id").alias("doc")), F.col("row") == F.col(ROW))
        members = stored(members.select("component_id", "row", "doc"), "near-members")
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "row"))["row"].alias("row"))
        gone = stored(members.select("row").join(first.select("row").hint("merge"), "row", "left_anti"), "near-gone", keep=True)
    return keep_ids(rows, ROW, gone, "left_anti").drop(ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item; null and wordless texts have none. Repeated rows are judged alike."""
    with scope():
        rows = _by_text(docs)
        found = contamination(rows.select(ROW, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW, digest=True)
        gone = stored(found.filter("contaminated").select("doc_id", DIGEST), "contaminated", keep=True)
    return _without(rows, gone)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens lean to the tempered margins of source, language and topic.

    Null values of a margin are a value of their own; a text without words is never drawn; repeated rows share their draw.
    """
    _, drawn = mix(docs, fraction=MIX_FRACTION)
    return drawn.filter(F.col("__tw_sampled")).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from its token files; a null text is an empty one."""
    return token_table(docs, tokenizer_path(), block_bytes=TOKEN_BLOCK)
