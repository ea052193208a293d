"""Byte tokenizer: id = byte + 4, no training."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphloom.functions.text import BYTE_VOCAB, SPECIALS, byte_ids, bytes_to_text
from glyphloom.operators.stream import Joining

# The documents are joined by a space, byte 32.
BYTE_JOINING = Joining(joint=(32 + 4,))


def byte_vocab(spark) -> DataFrame:
    """``(id, token)``: the special tokens and one hex name per byte."""
    token = F.when(F.col("i") < 4, F.get(F.array(*[F.lit(s) for s in SPECIALS]), "i")
                   ).otherwise(F.concat(F.lit("0x"), F.lpad(F.hex(F.col("i") - 4), 2, "0")))
    return spark.range(BYTE_VOCAB).select(F.col("id").cast("int").alias("i")).select(
        F.col("i").alias("id"), token.alias("token"))


def byte_encode(docs: DataFrame) -> DataFrame:
    """``(split, doc_id, ids)`` without special tokens; a projection, no shuffle."""
    return docs.select("split", "doc_id", byte_ids(F.col("text")).alias("ids"))


def byte_decode(encoded: DataFrame) -> DataFrame:
    """``(split, doc_id, text)``; special ids and malformed bytes are dropped."""
    return encoded.select("split", "doc_id", bytes_to_text(F.col("ids")).alias("text"))
