"""Registered queries of the operators: each takes ``(spark, sf_dir)``, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphloom.llm import (brown, decontam, langid, mincut, packing, passages, periodic, phrases,
                           pq, quality, secrets, simhash, suffix)
from glyphloom.llm.common import remainder, table
from glyphloom.llm.sql import SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_cgk_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_compact_windows(spark, sf_dir):
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    span = F.transform("spans", lambda s: F.concat_ws(
        ":", s["first_word"].cast("string"), s["end_word"].cast("string")))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_passages",
                        F.array_join(span, ",").alias("spans"))


def op3_minimum_bin_slack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_compression_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash_pivots(spark, sf_dir):
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op6_brown_classes(spark, sf_dir):
    return brown.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_product_quantisation(spark, sf_dir):
    return pq.embedding_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed(
        "id", "vec_id")


def op8_secret_ownership(spark, sf_dir):
    spans = F.col("spans")
    base = secrets.span_text(secrets.base_spans(spans))
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        *[secrets.count_kind(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(base, 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"))


def op9_bucket_pointer_dedup(spark, sf_dir):
    return suffix.repeated_bytes(table(spark, sf_dir, "documents")).withColumnRenamed(
        "id", "doc_id")


def op10_minimum_cut(spark, sf_dir):
    return mincut.extract_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars")


def op11_prefix_subtrees(spark, sf_dir):
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op12_partial_matching(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id")) == 0).alias("held_out"),
        "lang_pred", "score")


def op13_descending_lcp(spark, sf_dir):
    found = periodic.find_runs(table(spark, sf_dir, "documents"), rewrite=periodic.repeat_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    best = found.select("id", "runs", "collapsed", longest.alias("m"))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("m.back")).alias("start"), F.col("m.length").alias("length"),
        (-F.col("m.less")).alias("period"),
        F.call_function("div", F.col("m.length") * 1000, -F.col("m.less")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_cgk_decontamination,
    op2_compact_windows,
    op3_minimum_bin_slack,
    op4_compression_quality,
    op5_simhash_pivots,
    op6_brown_classes,
    op7_product_quantisation,
    op8_secret_ownership,
    op9_bucket_pointer_dedup,
    op10_minimum_cut,
    op11_prefix_subtrees,
    op12_partial_matching,
    op13_descending_lcp,
)}
