"""Tokenizers and run results in the file forms that other programs read.

Each file is bounded by ``vocab_size`` or by the number of epochs, is read and written
through Spark's file systems, and holds no more than one driver-side string.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from glyphloom.functions.text import SPECIALS, UNK
from glyphloom.operators.bpe import BpeModel
from glyphloom.operators.narrow import tokens_by_id
from glyphloom.operators.unigram import UnigramModel

_VOCAB = "id int, token string"
_MERGES = "rank int, left string, right string"
_PIECES = "id int, piece string, log_prob double"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with this content, replaced if it exists."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def _ids(tokens: list[str]) -> str:
    return json.dumps({t: i for i, t in enumerate(tokens)}, ensure_ascii=False)


def _vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(
        [(i, t) for t, i in json.loads(read_text(spark, path)).items()], _VOCAB)


def save_vocab_json(vocab: DataFrame, folder: str) -> None:
    """A word vocabulary as ``vocab.json``, token to id."""
    write_text(vocab.sparkSession, f"{folder}/vocab.json", _ids(tokens_by_id(vocab)))


def load_vocab_json(spark: SparkSession, folder: str) -> DataFrame:
    return _vocab(spark, f"{folder}/vocab.json")


def save_bpe_files(model: BpeModel, folder: str) -> None:
    """``vocab.json`` and ``merges.txt``, one merge per line in rank order."""
    spark = model.vocab.sparkSession
    save_vocab_json(model.vocab, folder)
    merges = sorted((r["rank"], r.left, r.right) for r in model.merges.collect())
    write_text(spark, f"{folder}/merges.txt", "#version: 0.2\n" + "".join(
        f"{left} {right}\n" for _, left, right in merges))


def load_bpe_files(spark: SparkSession, folder: str, mode: str = "raw") -> BpeModel:
    """The files hold neither pre-tokenizer nor special tokens: the mode is raw by default."""
    vocab = _vocab(spark, f"{folder}/vocab.json")
    lines = [line for line in read_text(spark, f"{folder}/merges.txt").split("\n")
             if line and not line.startswith("#version")]
    merges = spark.createDataFrame(
        [(rank, *line.split(" ")) for rank, line in enumerate(lines)], _MERGES)
    return BpeModel(vocab, merges, vocab.count(), mode)


def save_unigram_json(model: UnigramModel, folder: str) -> None:
    """``tokenizer.json`` with the scored pieces and the special tokens."""
    pieces = sorted((r.id, r.piece, r.log_prob) for r in model.pieces.collect())
    special = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False,
                "normalized": False, "special": True} for i, t in enumerate(SPECIALS)]
    write_text(model.pieces.sparkSession, f"{folder}/tokenizer.json", json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": special,
        "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None,
        "decoder": None, "model": {"type": "Unigram", "unk_id": UNK, "byte_fallback": False,
                                   "vocab": [[p, s] for _, p, s in pieces]}}, ensure_ascii=False))


def load_unigram_json(spark: SparkSession, folder: str) -> UnigramModel:
    found = json.loads(read_text(spark, f"{folder}/tokenizer.json"))["model"]
    if found["type"] != "Unigram":
        raise ValueError(f"{folder} does not hold a unigram model")
    rows = [(i, p, float(s)) for i, (p, s) in enumerate(found["vocab"])]
    return UnigramModel(spark.createDataFrame(rows, _PIECES), len(rows))


def save_result_files(records: DataFrame, folder: str) -> None:
    """Epoch records as one array per run, ``metrics_<tokenizer>_<scorer>.json``."""
    by_run: dict[tuple[str, str], list[dict]] = {}
    for row in sorted(records.collect(), key=lambda r: r.epoch):
        fields = row.asDict()
        by_run.setdefault((fields.pop("tokenizer"), fields.pop("scorer")), []).append(fields)
    for (tokenizer, scorer), rows in by_run.items():
        write_text(records.sparkSession, f"{folder}/metrics_{tokenizer}_{scorer}.json",
                   json.dumps(rows, indent=1))
