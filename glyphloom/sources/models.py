"""Saved vocabularies, tokenizer models and count tables, as Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphloom.operators.bpe import BpeModel
from glyphloom.operators.ngram import Bigrams
from glyphloom.operators.unigram import UnigramModel

CONFIG = "kind string, mode string, vocab_size int"


def _put(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def _put_config(spark: SparkSession, path: str, kind: str, mode: str, size: int) -> None:
    _put(spark.createDataFrame([(kind, mode, size)], CONFIG), path, "config")


def _get_config(spark: SparkSession, path: str, kind: str):
    row = spark.read.schema(CONFIG).parquet(f"{path}/config").first()
    if row is None or row.kind != kind:
        raise ValueError(f"{path} does not hold a {kind} model")
    return row


def save_vocab(vocab: DataFrame, path: str) -> None:
    """The word vocabulary ``(id, token)``."""
    _put(vocab.select("id", "token"), path, "vocab")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, token string").parquet(f"{path}/vocab")


def save_bpe(model: BpeModel, path: str) -> None:
    """Vocabulary, ranked merges and the full configuration."""
    save_vocab(model.vocab, path)
    _put(model.merges, path, "merges")
    _put_config(model.vocab.sparkSession, path, "bpe", model.mode, model.vocab_size)


def load_bpe(spark: SparkSession, path: str, mode: str | None = None) -> BpeModel:
    """The model in its saved mode.

    ``mode="raw"`` rebuilds it from vocabulary and merges alone: without pre-tokenizer
    and special tokens.
    """
    config = _get_config(spark, path, "bpe")
    merges = spark.read.schema("rank int, left string, right string").parquet(f"{path}/merges")
    return BpeModel(load_vocab(spark, path), merges, config.vocab_size, mode or config.mode)


def save_unigram(model: UnigramModel, path: str) -> None:
    _put(model.pieces, path, "pieces")
    _put_config(model.pieces.sparkSession, path, "unigram", "pretokenized", model.vocab_size)


def load_unigram(spark: SparkSession, path: str) -> UnigramModel:
    config = _get_config(spark, path, "unigram")
    pieces = spark.read.schema("id int, piece string, log_prob double").parquet(f"{path}/pieces")
    return UnigramModel(pieces, config.vocab_size)


def save_counts(model: Bigrams, path: str) -> None:
    """The count tables of a next-token model."""
    _put(model.pairs, path, "pairs")
    _put(model.contexts, path, "contexts")
    _put(model.unigrams, path, "unigrams")
    _put(model.totals.withColumn("vocab_size", F.lit(model.vocab_size)), path, "totals")


def load_counts(spark: SparkSession, path: str) -> Bigrams:
    totals = spark.read.parquet(f"{path}/totals")
    head = totals.agg(F.max("vocab_size").alias("v"), F.max("stage").alias("s")).first()
    return Bigrams(*(spark.read.parquet(f"{path}/{name}")
                     for name in ("pairs", "contexts", "unigrams")),
                   totals.drop("vocab_size"), head.v, head.s + 1)
