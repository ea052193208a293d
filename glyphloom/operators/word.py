"""Word tokenizer: the most frequent white-space words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from glyphloom.functions.text import SPECIALS, UNK, whitespace_tokens, with_specials
from glyphloom.operators.lookup import Keyed, keyed, lookup
from glyphloom.operators.narrow import decode_in_place, encode_in_place, tokens_by_id
from glyphloom.session import checkpointed


def special_rows(spark) -> DataFrame:
    """``(id, token)`` of the special tokens."""
    names = F.array(*[F.lit(s) for s in SPECIALS])
    return spark.range(len(SPECIALS)).select(
        F.col("id").cast("int").alias("id"),
        F.get(names, F.col("id").cast("int")).alias("token"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(token, n, first_doc)``: counts are combined before the one shuffle.

    All aggregates are longs, so the hash aggregate stays in place; a minimum over
    (document, position) pairs would sort every token instead.
    """
    tokens = docs.select("doc_id", F.explode(whitespace_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"),
                                       F.min("doc_id").alias("first_doc"))


def word_vocab(docs: DataFrame, vocab_size: int = 5000) -> DataFrame:
    """``(id, token)``: the special tokens, then words by count, ties by first occurrence.

    The ranking by count and first document settles all but ties inside one document.
    Only words in such a tie, among the top ones and those equal to the last of them,
    have their first position looked up in that document; the bound on its id prunes
    the second scan.  The counts are checkpointed, so the texts are counted once.
    """
    keep = vocab_size - len(SPECIALS)
    specials = special_rows(docs.sparkSession)
    if keep < 0:
        raise ValueError("vocab_size must cover the special tokens")
    counts = checkpointed(word_counts(docs).where(~F.col("token").isin(*SPECIALS)))
    top = counts.orderBy(F.desc("n"), "first_doc").limit(keep)
    bar = top.agg(F.min("n").alias("n"),
                  F.max_by("first_doc", F.struct(-F.col("n"), F.col("first_doc")))
                  .alias("first_doc")).first()
    if bar.n is None:
        return specials
    # At most vocab_size rows, plus the ties of the last one inside its document.
    tie = Window.partitionBy("n", "doc_id")
    candidates = checkpointed(counts.where(
        (F.col("n") > bar.n)
        | ((F.col("n") == bar.n) & (F.col("first_doc") <= bar.first_doc))
    ).select("token", "n", F.col("first_doc").alias("doc_id"))
        .withColumn("tied", F.count(F.lit(1)).over(tie) > 1))
    tied = candidates.where("tied").drop("tied")
    last_doc = tied.agg(F.max("doc_id")).first()[0]
    tied = F.broadcast(tied) if keyed(tied, "token").fits else tied
    places = candidates.where(~F.col("tied")).select("token", "n", "doc_id",
                                                     F.lit(0).alias("pos"))
    if last_doc is not None:
        places = places.unionByName(
            docs.where(F.col("doc_id") <= last_doc)
            .join(tied.select("doc_id"), "doc_id", "left_semi")
            .select("doc_id", F.posexplode(whitespace_tokens(F.col("text")))
                    .alias("pos", "token"))
            .join(tied, ["doc_id", "token"])
            .groupBy("token", "n", "doc_id").agg(F.min("pos").alias("pos")))
    order = [F.desc("n"), F.asc("doc_id"), F.asc("pos")]
    top = places.orderBy(*order).limit(keep)
    numbered = top.select(
        (F.row_number().over(Window.orderBy(*order)) + len(SPECIALS) - 1).alias("id"), "token")
    return specials.unionByName(numbered)


def word_encode_long(docs: DataFrame, by_token: Keyed, add_specials: bool = True) -> DataFrame:
    """``(split, doc_id, pos, id)``: one row per token; unknown words get the unk id."""
    tokens = whitespace_tokens(F.col("text"))
    if add_specials:
        tokens = F.concat(F.array(F.lit("<bos>")), tokens, F.array(F.lit("<eos>")))
    rows = docs.select("split", "doc_id", F.posexplode(tokens).alias("pos", "token"))
    return lookup(rows, by_token).select(
        "split", "doc_id", "pos", F.coalesce("id", F.lit(UNK)).alias("id"))


def word_encode(docs: DataFrame, vocab: DataFrame, add_specials: bool = False) -> DataFrame:
    """``(split, doc_id, ids)``; unknown words get the unk id.  No row moves."""
    ids = {token: i for i, token in enumerate(tokens_by_id(vocab))}
    encoded = encode_in_place(docs, whitespace_tokens(F.col("text")),
                              lambda token: [ids.get(token, UNK)])
    return encoded.withColumn("ids", with_specials(F.col("ids"))) if add_specials else encoded


def word_decode(encoded: DataFrame, vocab: DataFrame, skip_specials: bool = True) -> DataFrame:
    """Words joined by a space, special tokens left out; an unknown id is an error."""
    skip = tuple(range(len(SPECIALS))) if skip_specials else ()
    return decode_in_place(encoded, tokens_by_id(vocab), skip)
