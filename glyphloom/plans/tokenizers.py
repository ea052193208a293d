"""One interface over the four tokenizers, chosen by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphloom.functions.text import BYTE_VOCAB, with_specials
from glyphloom.operators import bpe, bytelevel, unigram, word
from glyphloom.operators.stream import Joining
from glyphloom.operators.subword import unit_counts
from glyphloom.session import checkpointed
from glyphloom.sources import models

NAMES = ("word", "bpe", "unigram", "byte")


@dataclass(frozen=True)
class Tokenizer:
    """Encodes ``(split, doc_id, text)`` to ``(split, doc_id, ids)`` and back."""

    name: str
    vocab: DataFrame
    vocab_size: int
    joining: Joining
    _encode: Callable[[DataFrame], DataFrame]
    _decode: Callable[[DataFrame, bool], DataFrame]
    model: object = None

    def encode(self, docs: DataFrame, add_specials: bool = True) -> DataFrame:
        encoded = self._encode(docs)
        if not add_specials:
            return encoded
        if self.joining.joint and self.name != "byte":
            # Raw BPE: the markers are text, with the space beside them.
            front, back = (F.array(*[F.lit(i) for i in part])
                           for part in (self.joining.prefix, self.joining.suffix))
            return encoded.withColumn("ids", F.concat(front, "ids", back))
        return encoded.withColumn("ids", with_specials(F.col("ids")))

    def decode(self, encoded: DataFrame, skip_specials: bool = True) -> DataFrame:
        return self._decode(encoded, skip_specials)

    def renamed(self, name: str) -> Tokenizer:
        return replace(self, name=name)


def check_name(name: str) -> None:
    if name not in NAMES:
        raise ValueError(f"unknown tokenizer {name!r}, expected one of {NAMES}")


def word_tokenizer(vocab: DataFrame) -> Tokenizer:
    """From a stored vocabulary ``(id, token)``."""
    return Tokenizer("word", vocab, vocab.count(), Joining(),
                     lambda docs: word.word_encode(docs, vocab),
                     lambda enc, skip: word.word_decode(enc, vocab, skip))


def byte_tokenizer(spark: SparkSession) -> Tokenizer:
    return Tokenizer("byte", bytelevel.byte_vocab(spark), BYTE_VOCAB,
                     bytelevel.BYTE_JOINING, bytelevel.byte_encode,
                     lambda enc, skip: bytelevel.byte_decode(enc))


def bpe_tokenizer(model: bpe.BpeModel) -> Tokenizer:
    return Tokenizer("bpe", model.vocab, model.vocab_size, model.joining(),
                     lambda docs: bpe.bpe_encode(docs, model),
                     lambda enc, skip: bpe.bpe_decode(enc, model, skip), model)


def unigram_tokenizer(model: unigram.UnigramModel) -> Tokenizer:
    return Tokenizer("unigram", model.vocab, model.vocab_size, model.joining(),
                     lambda docs: unigram.unigram_encode(docs, model),
                     lambda enc, skip: unigram.unigram_decode(enc, model, skip), model)


def train_tokenizer(name: str, docs: DataFrame, vocab_size: int = 5000,
                    units: DataFrame | None = None, mode: str = "pretokenized",
                    seed_size: int = 1_000_000) -> Tokenizer:
    """Train on all of ``docs``; byte needs no training.

    ``units`` are the stored unit counts of ``docs``, if they have been counted before.
    """
    check_name(name)
    if name == "word":
        return word_tokenizer(checkpointed(word.word_vocab(docs, vocab_size)))
    if name == "byte":
        return byte_tokenizer(docs.sparkSession)
    units = checkpointed(unit_counts(docs)) if units is None else units
    if name == "bpe":
        return bpe_tokenizer(replace(bpe.bpe_train(units, vocab_size), mode=mode))
    return unigram_tokenizer(unigram.unigram_train(units, vocab_size, seed_size))


def save_tokenizer(tokenizer: Tokenizer, path: str) -> None:
    """What :func:`load_tokenizer` needs; nothing for bytes."""
    if tokenizer.name == "word":
        models.save_vocab(tokenizer.vocab, path)
    elif tokenizer.name == "bpe":
        models.save_bpe(tokenizer.model, path)
    elif tokenizer.name == "unigram":
        models.save_unigram(tokenizer.model, path)


def load_tokenizer(name: str, spark: SparkSession, path: str,
                   mode: str | None = None) -> Tokenizer:
    """Load a saved tokenizer by name."""
    check_name(name)
    if name == "word":
        return word_tokenizer(models.load_vocab(spark, path))
    if name == "bpe":
        return bpe_tokenizer(models.load_bpe(spark, path, mode))
    if name == "unigram":
        return unigram_tokenizer(models.load_unigram(spark, path))
    return byte_tokenizer(spark)
