"""The corpus pipeline: reject poor texts, drop near copies and benchmark leaks, redact
secrets, pack into windows.

Each stage takes the documents that its predecessor kept, as written and read again, and
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphloom.llm import decontam, packing, quality, secrets, simhash
from glyphloom.llm.common import row_key, table
from glyphloom.session import checkpointed, small, written

LEAST_SCORE = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    It learns from the labels of the documents it is given; no labels reject nothing.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not (model.good and model.bad):
        return docs
    scored = quality.score(docs, model, into="__quality")
    return scored.where(F.col("__quality") >= LEAST_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component, the one with the smallest id (rows without id
    last), of several such rows the one with the smallest key of id and text.

    Rows are told apart by id and text, so different texts under one id, or without an id,
    are documents of their own, and of rows that repeat both one stays.
    """
    keyed = docs.withColumn("__row", row_key())
    found = simhash.simhash_groups(keyed, key_col="__row")
    keep = found.where("row_key = component_key").select(F.col("row_key").alias("__row"))
    # Repeated rows are combined before the join, so many copies leave each task once.
    kept = keyed.dropDuplicates(["__row"]).join(keep, "__row", "left_semi")
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; rows are told apart by id and text."""
    keyed = docs.withColumn("__row", row_key())
    found = decontam.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="__row")
    leaked = checkpointed(found.select(F.col("id").alias("__row")).distinct())
    return keyed.join(small(leaked, leaked.count()), "__row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced and ``n_chars`` counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(
        *docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in windows of 2048 tokens."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack_windows", pack_windows),
]

# Compressed sizes, walks and tokens have no SQL; the tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
