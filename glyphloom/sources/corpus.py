"""Corpora: named splits of a document table, and the one-text-per-line file form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphloom.functions.text import one_line
from glyphloom.session import parallelism, spread

SPLITS = ("train", "val", "test")


def split_of(doc_id: Column) -> Column:
    """The fixed 80/10/10 split by the last digit of the document id."""
    digit = F.pmod(doc_id, F.lit(10))
    return F.when(digit < 8, "train").when(digit == 8, "val").otherwise("test")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(split, doc_id, text)`` of the documents table."""
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread(scan, "doc_id").select(
        split_of(F.col("doc_id")).alias("split"), "doc_id", "text")


def read_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents, ordered by conversation and turn, in one ``train`` split."""
    scan = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns, conversations = 1 << 20, 1 << 42
    fits = (F.col("turn").between(0, turns - 1)
            & F.col("conv_id").between(-conversations, conversations - 1))
    doc_id = F.when(fits, F.col("conv_id") * turns + F.col("turn")).otherwise(
        F.raise_error(F.lit("turn or conversation out of range")).cast("bigint"))
    return spread(scan.select(doc_id.alias("doc_id"), "text"), "doc_id").select(
        F.lit("train").alias("split"), "doc_id", "text")


def pick_split(docs: DataFrame, split: str) -> DataFrame:
    """One split by name; an unknown name is an error."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    return docs.where(F.col("split") == split)


def hash_draw(seed: Column, doc_id: Column) -> Column:
    """A number in 0..2**32 - 1 drawn from seed and id (null: none), the same on every run."""
    digest = F.md5(F.concat(seed, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def seeded_split(docs: DataFrame, test_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Random split by a hash of seed and id: stable under any partitioning."""
    cut = int(round(test_size * 10_000))
    held_out = F.pmod(hash_draw(F.lit(str(seed)), F.col("doc_id")), F.lit(10_000)) < cut
    return docs.withColumn("split", F.when(held_out, "test").otherwise("train"))


def first_rows(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents in id order; fewer than ``n`` is an error on use.

    The ids alone are ranked, so texts are not moved by the sort; fewer, larger tasks
    each send their first ``n`` ids to the last step.
    """
    ids = (docs.select("doc_id").coalesce(parallelism(docs.sparkSession))
           .orderBy("doc_id").limit(n))
    edge = ids.agg(F.count(F.lit(1)).alias("k"), F.max("doc_id").alias("last")).select(
        F.when(F.col("k") == n, F.col("last")).otherwise(
            F.raise_error(F.lit(f"fewer than {n} rows")).cast("bigint")))
    return docs.where(F.col("doc_id") <= edge.scalar())


def corpus_lines(docs: DataFrame) -> DataFrame:
    """One line per document, as written by :func:`write_corpus`."""
    return docs.select(one_line(F.col("text")).alias("value"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """Write the line form, one file per partition."""
    corpus_lines(docs).write.mode("overwrite").text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a corpus file or folder."""
    return spark.read.text(path, lineSep="\n")
