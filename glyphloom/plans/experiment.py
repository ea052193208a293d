"""Train a next-token model on one tokenization and measure it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphloom.functions.metrics import METRICS, metric_columns
from glyphloom.operators import ngram
from glyphloom.operators.epoch import epoch_weights, last_batch_pairs
from glyphloom.operators.stream import (layout, pair_counts, split_sizes, store_encoded,
                                        stream_lengths, weighted_pairs)
from glyphloom.plans.tokenizers import Tokenizer
from glyphloom.session import checkpointed, written
from glyphloom.sources import models
from glyphloom.sources.corpus import SPLITS, hash_draw


@dataclass(frozen=True)
class Settings:
    """The parameters of a run."""

    context: int = 128
    batch: int = 32
    epochs: int = 5
    k: float = 1.0
    share: float = 0.75
    smoothing: float = 0.1
    seed: int = 42


def corpus_totals(docs: DataFrame) -> DataFrame:
    """``(split, n_docs, n_chars, n_bytes)`` of the raw texts, join spaces left out."""
    return docs.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.char_length("text")).alias("n_chars"),
        F.sum(F.octet_length("text")).alias("n_bytes"))


@dataclass(frozen=True)
class Encoded:
    """A corpus encoded once, and the narrow tables every run needs.

    ``pairs(split, slice, prev, cur, n)`` counts per training slice,
    ``weighted(split, prev, cur, n, weight)`` all slices with their window weight,
    ``shuffled(epoch, prev, cur, weight)`` the train split with the weights of its shuffled
    epochs, and ``totals`` has one row per split.
    """

    tokenizer: Tokenizer
    settings: Settings
    stored: DataFrame | None
    pairs: DataFrame
    weighted: DataFrame
    shuffled: DataFrame
    totals: DataFrame


def prepare(docs: DataFrame, tokenizer: Tokenizer, settings: Settings = Settings()) -> Encoded:
    """Encode ``docs``, write the arrays by split, and derive the narrow tables.

    Pairs are counted per training slice, a hash of the document id; all later steps
    work on these counts.
    """
    stored = store_encoded(tokenizer.encode(docs, add_specials=False))
    placed = written(layout(stored, tokenizer.joining), "layout")
    slice_of = F.pmod(hash_draw(F.lit("slice"), F.col("doc_id")),
                      F.lit(settings.epochs)).cast("int")
    pairs = written(pair_counts(stored.withColumn("slice", slice_of), tokenizer.joining,
                                placed, by=("slice",)), "pairs")
    merged = pairs.groupBy("split", "prev", "cur").agg(F.sum("n").alias("n"))
    weights = written(weighted_pairs(stored, tokenizer.joining, placed, merged,
                                     settings.context, settings.batch), "weighted")
    lengths = checkpointed(stream_lengths(stored, tokenizer.joining))
    totals = corpus_totals(docs).join(lengths, "split").withColumnRenamed("length", "n_tokens")
    return Encoded(tokenizer, settings, stored, pairs, weights,
                   _shuffled(stored, placed, tokenizer, merged, lengths, settings),
                   checkpointed(totals))


def _shuffled(stored: DataFrame, placed: DataFrame, tokenizer: Tokenizer, merged: DataFrame,
              lengths: DataFrame, settings: Settings) -> DataFrame:
    """The pairs of the train split, weighted by the shuffled batches of each epoch."""
    train = F.col("split") == "train"
    stored, placed = stored.where(train), placed.where(train)
    sizes = split_sizes(lengths.where(train), settings.context, settings.batch).select(
        "split", "n_windows")
    # Batches of one window weigh all windows alike.
    uniform = weighted_pairs(stored, tokenizer.joining, placed, merged.where(train),
                             settings.context, 1)
    last = last_batch_pairs(stored, placed, tokenizer.joining, sizes, settings.context,
                            settings.batch, settings.seed, settings.epochs)
    return written(epoch_weights(uniform, last, sizes, settings.context, settings.batch)
                   .drop("split"), "shuffled")


def train_counts(data: Encoded) -> ngram.Bigrams:
    """The final model, all of the train split, counted once for all scorers."""
    pairs = data.weighted.where("split = 'train' AND n > 0").select("prev", "cur", "n")
    return ngram.stored(ngram.fit(pairs, data.tokenizer.vocab_size))


def epoch_counts(data: Encoded) -> ngram.Bigrams:
    """The models after each epoch, counted once for all scorers."""
    train = data.pairs.where("split = 'train'").drop("split")
    return ngram.stored(ngram.fit_stages(train, data.tokenizer.vocab_size, data.settings.epochs))


def evaluate(model: ngram.Bigrams, data: Encoded, kind: str,
             splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``(split, stage, metrics, nll_plain, unk_rate, n_targets)`` of the asked splits."""
    ngram.check_kind(kind)
    for split in splits:
        if split not in SPLITS:
            raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    pairs = data.weighted.where(F.col("split").isin(*splits))
    settings = data.settings
    losses = ngram.mean_losses(ngram.score(model, pairs, kind, settings.k, settings.share))
    # One row per split.
    return losses.join(F.broadcast(data.totals), "split").select(
        "split", "stage",
        *metric_columns(F.col("nll_token"), F.col("n_tokens"), F.col("n_chars"),
                        F.col("n_bytes")),
        "nll_plain", "unk_rate", "n_targets")


def run_metrics(data: Encoded, kind: str, splits: tuple[str, ...] = SPLITS,
                model: ngram.Bigrams | None = None) -> DataFrame:
    """One row per split for the final model, with the run's keys."""
    return evaluate(model or train_counts(data), data, kind, splits).drop("stage").select(
        F.lit(data.tokenizer.name).alias("tokenizer"), F.lit(kind).alias("scorer"), "*")


def evaluate_saved(spark: SparkSession, path: str, data: Encoded, kind: str,
                   split: str) -> DataFrame:
    """Score the requested split with count tables saved earlier."""
    return evaluate(models.load_counts(spark, path), data, kind, (split,)).drop("stage")


def epoch_records(data: Encoded, kind: str, model: ngram.Bigrams | None = None) -> DataFrame:
    """The twelve-field record of every epoch, with the run's keys.

    Epoch ``e`` is the model after slices 0..e of the training data: all epochs come
    from one set of counts.  The train loss is the mean of the batch means over the windows
    in the order of that epoch.  There is no learning rate; ``lr`` is null.
    """
    settings = data.settings
    model = model or epoch_counts(data)
    train_loss = ngram.smoothed_loss(model, data.shuffled, kind, settings.k, settings.share,
                                     settings.smoothing)
    val = evaluate(model, data, kind, ("val",))
    # One row per epoch on both sides.
    return val.join(F.broadcast(train_loss), "stage").select(
        F.lit(data.tokenizer.name).alias("tokenizer"), F.lit(kind).alias("scorer"),
        F.col("stage").alias("epoch"), "split", *METRICS, "train_loss",
        F.col("nll_token").alias("val_loss"), F.lit(None).cast("double").alias("lr"))


def test_record(data: Encoded, kind: str) -> DataFrame:
    """The eight-field record of the final model on the test split, with the run's keys."""
    return run_metrics(data, kind, ("test",)).select(
        "tokenizer", "scorer", "split", *METRICS)
