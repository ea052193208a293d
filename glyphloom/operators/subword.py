"""What BPE and unigram share: unit counts, the alphabet, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from glyphloom.functions.text import PRETOKEN, SPECIALS, UNK, pretokens, strip_specials
from glyphloom.operators.narrow import decode_in_place, tokens_by_id


def unit_counts(docs: DataFrame, pattern: str = PRETOKEN) -> DataFrame:
    """``(unit, n)``: distinct pre-tokens with their frequency; all training starts here."""
    return (docs.select(F.explode(pretokens(F.col("text"), pattern)).alias("unit"))
            .groupBy("unit").agg(F.count(F.lit(1)).alias("n")))


def alphabet(units: DataFrame) -> DataFrame:
    """``(id, token)``: the characters by code point, numbered after the specials.

    At most one row per Unicode code point reaches the numbering.
    """
    chars = units.select(F.explode(F.split("unit", "")).alias("token")).distinct()
    number = F.row_number().over(Window.orderBy("token")) + (len(SPECIALS) - 1)
    return chars.select(number.alias("id"), "token")


def subword_decode(encoded: DataFrame, vocab: DataFrame, registered: bool = True,
                   skip_specials: bool = True) -> DataFrame:
    """``(split, doc_id, text)``: tokens joined by spaces, special tokens removed.

    ``registered`` says whether the model knows the special tokens as such: then they
    are dropped before joining, whatever ``skip_specials`` says.  It does not undo the
    splitting: pieces of one word stay apart.
    """
    skip = tuple(range(len(SPECIALS))) if registered else ()
    joined = decode_in_place(encoded, tokens_by_id(vocab), skip)
    if not skip_specials:
        return joined
    return joined.withColumn("text", strip_specials(F.col("text")))


def special_ids(unit: str) -> list[int] | None:
    return [SPECIALS.index(unit)] if unit in SPECIALS else None


def fuse_unknown(ids: list[int]) -> list[int]:
    """Runs of the unknown id reduced to one."""
    return [i for k, i in enumerate(ids) if i != UNK or k == 0 or ids[k - 1] != UNK]
