"""Registered queries: each takes ``(spark, sf_dir)`` and reads the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphloom.functions.metrics import METRICS, interior_weight
from glyphloom.functions.text import SPECIALS, whitespace_tokens
from glyphloom.operators import bpe, bytelevel, epoch, ngram, stream, subword, unigram, word
from glyphloom.operators.lookup import keyed, lookup
from glyphloom.plans import compare, experiment, ledger
from glyphloom.plans.tokenizers import (Tokenizer, bpe_tokenizer, byte_tokenizer,
                                        train_tokenizer, unigram_tokenizer, word_tokenizer)
from glyphloom.session import checkpointed, scratch_path, spread
from glyphloom.sources import corpus, files, models, runs

VOCAB = 5000
SETTINGS = experiment.Settings()
# Sizes of the queries that SQL repeats; the others train to VOCAB.
SMALL_MERGES = 8
MERGES = 64
SEED_PIECES = 2000
GIVEN = 300
SEEDS = 1_000_000
Query = Callable[[SparkSession, str], DataFrame]


def _joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Corpus ---------------------------------------------------------------------------

def corpus_totals(spark, sf_dir):
    return experiment.corpus_totals(corpus.read_documents(spark, sf_dir))


def first_rows(spark, sf_dir):
    docs = corpus.pick_split(corpus.read_documents(spark, sf_dir), "train")
    return corpus.first_rows(docs, 100).select("doc_id", "text")


def seeded_split(spark, sf_dir):
    return corpus.seeded_split(corpus.read_documents(spark, sf_dir)).select("doc_id", "split")


def corpus_lines(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    corpus.write_corpus(corpus.read_documents(spark, sf_dir), path)
    return corpus.read_corpus(spark, path)


# Word and byte tokenizers ---------------------------------------------------------

def word_counts(spark, sf_dir):
    return word.word_counts(corpus.read_documents(spark, sf_dir))


def _word(spark, docs, size: int = VOCAB) -> Tokenizer:
    """Trained, saved and loaded again."""
    path = scratch_path(spark, "word")
    models.save_vocab(word.word_vocab(docs, size), path)
    return word_tokenizer(models.load_vocab(spark, path))


def word_vocab(spark, sf_dir):
    return _word(spark, corpus.read_documents(spark, sf_dir)).vocab


def word_encode(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    by_token = keyed(_word(spark, docs).vocab, "token")
    return word.word_encode_long(docs, by_token).select("doc_id", "pos", "id")


def word_encode_arrays(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    return _word(spark, docs).encode(docs).select(
        "doc_id", F.size("ids").alias("n_ids"), _joined(F.col("ids")).alias("ids"))


def word_decode(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    tokenizer = _word(spark, docs)
    return tokenizer.decode(tokenizer.encode(docs)).select("doc_id", "text")


def byte_encode(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    return byte_tokenizer(spark).encode(docs).select(
        "doc_id", F.size("ids").alias("n_ids"), _joined(F.col("ids")).alias("ids"))


def byte_decode(spark, sf_dir):
    tokenizer = byte_tokenizer(spark)
    encoded = tokenizer.encode(corpus.read_documents(spark, sf_dir))
    return tokenizer.decode(encoded).select("doc_id", "text")


def language_profile(spark, sf_dir):
    """Tokens per character and unknown share of each language, word tokenizer.

    Tokens are looked up and counted in long form: only the counts are shuffled.
    """
    docs = corpus.read_documents(spark, sf_dir)
    vocab = checkpointed(word.word_vocab(docs, VOCAB))
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    langs = spread(scan, "doc_id")
    sizes = langs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum(F.char_length("text")).alias("n_chars"))
    tokens = langs.select("lang", F.explode(whitespace_tokens(F.col("text"))).alias("token"))
    counted = (lookup(tokens, keyed(vocab, "token")).groupBy("lang")
               .agg(F.count(F.lit(1)).alias("n_tokens"),
                    F.count_if(F.col("id").isNull()).alias("n_unk")))
    return sizes.join(counted, "lang").select(
        "lang", "n_docs", "n_chars", "n_tokens",
        F.round(F.col("n_tokens") / F.col("n_chars"), 6).alias("tokens_per_char"),
        F.round(F.col("n_unk") / F.col("n_tokens"), 6).alias("unk_rate"))


# Subword tokenizers ---------------------------------------------------------------

def pretoken_counts(spark, sf_dir):
    return subword.unit_counts(corpus.read_documents(spark, sf_dir))


def alphabet(spark, sf_dir):
    return subword.alphabet(subword.unit_counts(corpus.read_documents(spark, sf_dir)))


def _bpe_model(docs, merges: int | None) -> bpe.BpeModel:
    """Trained to a number of merges, or to the whole vocabulary."""
    units = checkpointed(subword.unit_counts(docs))
    if merges is None:
        return bpe.bpe_train(units, VOCAB)
    size = len(SPECIALS) + subword.alphabet(units).count() + merges
    return bpe.bpe_train(units, size)


def _bpe(spark, docs, merges: int | None, mode: str = "pretokenized") -> Tokenizer:
    """Trained, saved and loaded again."""
    path = scratch_path(spark, "bpe")
    models.save_bpe(_bpe_model(docs, merges), path)
    return bpe_tokenizer(models.load_bpe(spark, path, mode))


def _bpe_merges(merges: int | None) -> Query:
    def query(spark, sf_dir):
        return _bpe_model(corpus.read_documents(spark, sf_dir), merges).merges
    return query


def _bpe_vocab(merges: int | None) -> Query:
    def query(spark, sf_dir):
        return _bpe(spark, corpus.read_documents(spark, sf_dir), merges).vocab
    return query


def _bpe_encoded(mode: str, merges: int | None) -> Query:
    def query(spark, sf_dir):
        docs = corpus.read_documents(spark, sf_dir)
        encoded = _bpe(spark, docs, merges, mode).encode(docs, add_specials=False)
        return encoded.select("doc_id", F.size("ids").alias("n_ids"),
                              _joined(F.col("ids")).alias("ids"))
    return query


def _bpe_decoded(merges: int | None) -> Query:
    def query(spark, sf_dir):
        docs = corpus.read_documents(spark, sf_dir)
        tokenizer = _bpe(spark, docs, merges)
        return tokenizer.decode(tokenizer.encode(docs)).select("doc_id", "text")
    return query


def _unigram_seed(size: int) -> Query:
    def query(spark, sf_dir):
        units = subword.unit_counts(corpus.read_documents(spark, sf_dir))
        return unigram.substring_seed(units, size)
    return query


def _given_pieces(units: DataFrame) -> DataFrame:
    """``(piece, log_prob)``: every character and the GIVEN best pairs, scored by share."""
    singles = units.select("n", F.explode(F.split("unit", "")).alias("piece")).groupBy(
        "piece").agg(F.sum("n").alias("n"))
    pairs = unigram.substring_seed(units, GIVEN, 2).select("piece", "n")
    pieces = checkpointed(singles.unionAll(pairs))
    total = F.broadcast(pieces.agg(F.sum("n").alias("total")))
    return pieces.crossJoin(total).select("piece", F.ln(F.col("n") / F.col("total")).alias("log_prob"))


def unigram_expected(spark, sf_dir):
    """Expected uses of given pieces over all segmentations of the corpus."""
    units = checkpointed(subword.unit_counts(corpus.read_documents(spark, sf_dir)))
    return unigram.expected_piece_uses(units, _given_pieces(units)).select(
        "piece", F.round("uses", 3).alias("uses"))


def unigram_given_encode(spark, sf_dir):
    """Documents encoded with a model of given pieces, saved as a file and loaded again."""
    docs = corpus.read_documents(spark, sf_dir)
    units = checkpointed(subword.unit_counts(docs))
    path = scratch_path(spark, "unigram")
    files.save_unigram_json(unigram.given_model(_given_pieces(units)), path)
    return unigram_tokenizer(files.load_unigram_json(spark, path)).encode(
        docs, add_specials=False).select("doc_id", F.size("ids").alias("n_ids"),
                                         _joined(F.col("ids")).alias("ids"))


def _unigram(spark, docs) -> Tokenizer:
    return train_tokenizer("unigram", docs, VOCAB, seed_size=SEEDS)


def unigram_vocab(spark, sf_dir):
    return _unigram(spark, corpus.read_documents(spark, sf_dir)).vocab


def unigram_encode(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    return _unigram(spark, docs).encode(docs).select(
        "doc_id", F.size("ids").alias("n_ids"), _joined(F.col("ids")).alias("ids"))


def unigram_decode(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    tokenizer = _unigram(spark, docs)
    return tokenizer.decode(tokenizer.encode(docs)).select("doc_id", "text")


# Streams, windows, batches --------------------------------------------------------

def _word_stream(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    tokenizer = _word(spark, corpus.pick_split(docs, "train"))
    stored = stream.store_encoded(tokenizer.encode(docs, add_specials=False))
    return stored, tokenizer.joining


def _word_segments(spark, sf_dir):
    stored, joining = _word_stream(spark, sf_dir)
    return stream.segments(stored, stream.layout(stored, joining), joining)


def stream_positions(spark, sf_dir):
    return stream.stream_positions(_word_segments(spark, sf_dir))


def _windows(context: int, stride: int) -> Query:
    def query(spark, sf_dir):
        return stream.next_token_windows(_word_segments(spark, sf_dir), context, stride,
                                         sides="text")
    return query


def lm_windows_full(spark, sf_dir):
    """Every window of 128 ids at stride 1; both sides as digests."""
    return stream.next_token_windows(_word_segments(spark, sf_dir), SETTINGS.context, 1,
                                     sides="digest")


def split_sizes(spark, sf_dir):
    stored, joining = _word_stream(spark, sf_dir)
    return stream.split_sizes(stream.stream_lengths(stored, joining),
                              SETTINGS.context, SETTINGS.batch)


def lm_batches(spark, sf_dir):
    """Train windows shuffled, the others in order."""
    stored, joining = _word_stream(spark, sf_dir)
    lengths = checkpointed(stream.stream_lengths(stored, joining))
    starts = stream.window_starts(lengths, SETTINGS.context)
    sizes = stream.split_sizes(lengths, SETTINGS.context, SETTINGS.batch)
    train = F.col("split") == "train"
    return epoch.shuffled_batches(starts.where(train), sizes, SETTINGS.batch, SETTINGS.seed).unionByName(
        stream.ordered_batches(starts.where(~train), SETTINGS.batch))


def target_weights(spark, sf_dir):
    """Weight of each target, counted in windows of full batches."""
    stored, joining = _word_stream(spark, sf_dir)
    lengths = stream.stream_lengths(stored, joining)
    segs = stream.segments(stored, stream.layout(stored, joining), joining)
    weights = stream.target_weights(stream.stream_positions(segs), lengths,
                                    SETTINGS.context, SETTINGS.batch)
    one = interior_weight(F.col("length"), SETTINGS.context, SETTINGS.batch) / SETTINGS.context
    return weights.join(F.broadcast(lengths), "split").select(
        "split", "pos", F.round(F.col("weight") / one, 6).alias("n_windows"))


# Next-token models ----------------------------------------------------------------

def word_bigrams(spark, sf_dir):
    return stream.pair_counts(*_word_stream(spark, sf_dir))


def byte_bigrams(spark, sf_dir):
    stored = stream.store_encoded(bytelevel.byte_encode(corpus.read_documents(spark, sf_dir)))
    return stream.pair_counts(stored, bytelevel.BYTE_JOINING)


def conversation_bigrams(spark, sf_dir):
    """Adjacent byte pairs of all turns, in conversation and turn order."""
    docs = corpus.read_conversations(spark, sf_dir)
    stored = stream.store_encoded(bytelevel.byte_encode(docs))
    return stream.pair_counts(stored, bytelevel.BYTE_JOINING)


def _scored(kind: str) -> Query:
    def query(spark, sf_dir):
        """Every pair of every split with its loss under the model of the train split."""
        docs = corpus.read_documents(spark, sf_dir)
        tokenizer = _word(spark, corpus.pick_split(docs, "train"))
        stored = stream.store_encoded(tokenizer.encode(docs, add_specials=False))
        pairs = stream.pair_counts(stored, tokenizer.joining).persist()
        model = ngram.fit(pairs.where("split = 'train'"), tokenizer.vocab_size)
        return ngram.score(model, pairs, kind).select(
            "split", "prev", "cur", "n", F.round("nll", 6).alias("nll"))
    return query


def smoothed_loss(spark, sf_dir):
    data = _prepared(spark, sf_dir, "word")
    model = experiment.train_counts(data)
    parts = [ngram.smoothed_loss(model, data.shuffled, kind, SETTINGS.k, SETTINGS.share,
                                 SETTINGS.smoothing)
             .select(F.lit(kind).alias("scorer"), F.round("train_loss", 6).alias("train_loss"))
             for kind in ngram.KINDS]
    return parts[0].unionByName(parts[1])


# Runs -----------------------------------------------------------------------------

# The tokenizers whose runs SQL repeats, and all of them: the whole grid.
SHORT = ("word", "byte")
GRID = (*SHORT, "bpe", ledger.RAW, "unigram")


def _ledger(spark, sf_dir) -> ledger.Ledger:
    return ledger.Ledger.of(corpus.read_documents(spark, sf_dir), SETTINGS)


def _prepared(spark, sf_dir, name: str) -> experiment.Encoded:
    return _ledger(spark, sf_dir).run(name, VOCAB)


def _all_runs(spark, sf_dir, names) -> DataFrame:
    book = _ledger(spark, sf_dir)

    def run(name):
        data = book.run(name, VOCAB)
        book.model(data, VOCAB)  # counted with the run, for all scorers
        return data

    return compare.all_runs(ledger.side_by_side(run, names), ledger=book, size=VOCAB)


def _run_metrics(names) -> Query:
    def query(spark, sf_dir):
        return _rounded(_all_runs(spark, sf_dir, names), *METRICS, "nll_plain", "unk_rate")
    return query


def _comparison(names) -> Query:
    def query(spark, sf_dir):
        found = compare.comparison(_all_runs(spark, sf_dir, names))
        return _rounded(found, *[c for c in found.columns if c != "tokenizer"])
    return query


def saved_model_score(spark, sf_dir):
    """Count tables saved, loaded, and used on the validation split."""
    data = _prepared(spark, sf_dir, "word")
    path = scratch_path(spark, "counts")
    models.save_counts(experiment.train_counts(data), path)
    found = experiment.evaluate_saved(spark, path, data, ngram.ADD_K, "val")
    return _rounded(found, *METRICS, "nll_plain", "unk_rate")


def _epochs(spark, sf_dir, names):
    """The epoch records of each run of the grid, one row per epoch."""
    book = _ledger(spark, sf_dir)

    def run(name):
        data = book.run(name, VOCAB)
        model = book.model(data, VOCAB, epochs=True)
        return [checkpointed(experiment.epoch_records(data, kind, model))
                for kind in ngram.KINDS]

    for records in ledger.side_by_side(run, names).values():
        yield from records


def _saved_epochs(spark, sf_dir, names) -> DataFrame:
    """Epoch records of the grid, written run by run and read back."""
    path = scratch_path(spark, "runs")
    for records in _epochs(spark, sf_dir, names):
        runs.write_runs(records, path)
    return runs.read_runs(spark, path)


def _epoch_records(names) -> Query:
    def query(spark, sf_dir):
        return _rounded(_saved_epochs(spark, sf_dir, names), *METRICS, "train_loss", "val_loss")
    return query


def _result_files(names) -> Query:
    """Epoch records written as one array file per run, and read back."""
    def query(spark, sf_dir):
        path = scratch_path(spark, "results")
        for records in _epochs(spark, sf_dir, names):
            files.save_result_files(records, path)
        return _rounded(runs.read_result_files(spark, path), *METRICS, "train_loss", "val_loss")
    return query


def _curves(names) -> Query:
    def query(spark, sf_dir):
        return _rounded(compare.curves(_saved_epochs(spark, sf_dir, names)),
                        "train_loss", "val_loss")
    return query


def _curve_summary(names) -> Query:
    def query(spark, sf_dir):
        return _rounded(compare.curve_summary(_saved_epochs(spark, sf_dir, names)), "low", "high")
    return query


QUERIES: dict[str, Query] = {
    "corpus_totals": corpus_totals,
    "first_rows": first_rows,
    "seeded_split": seeded_split,
    "corpus_lines": corpus_lines,
    "word_counts": word_counts,
    "word_vocab": word_vocab,
    "word_encode": word_encode,
    "word_encode_arrays": word_encode_arrays,
    "word_decode": word_decode,
    "byte_encode": byte_encode,
    "byte_decode": byte_decode,
    "language_profile": language_profile,
    "pretoken_counts": pretoken_counts,
    "alphabet": alphabet,
    "bpe_merges": _bpe_merges(MERGES),
    "bpe_vocab": _bpe_vocab(MERGES),
    "bpe_encode": _bpe_encoded("pretokenized", SMALL_MERGES),
    "bpe_encode_raw": _bpe_encoded("raw", SMALL_MERGES),
    "bpe_decode": _bpe_decoded(SMALL_MERGES),
    "unigram_seed": _unigram_seed(SEED_PIECES),
    "unigram_expected": unigram_expected,
    "unigram_given_encode": unigram_given_encode,
    "unigram_vocab": unigram_vocab,
    "unigram_encode": unigram_encode,
    "unigram_decode": unigram_decode,
    "stream_positions": stream_positions,
    "lm_windows": _windows(8, 1),
    "lm_windows_stride16": _windows(128, 16),
    "lm_windows_full": lm_windows_full,
    "split_sizes": split_sizes,
    "lm_batches": lm_batches,
    "target_weights": target_weights,
    "word_bigrams": word_bigrams,
    "byte_bigrams": byte_bigrams,
    "conversation_bigrams": conversation_bigrams,
    "bigram_score": _scored(ngram.ADD_K),
    "interpolated_score": _scored(ngram.INTERPOLATED),
    "smoothed_loss": smoothed_loss,
    "run_metrics": _run_metrics(SHORT),
    "run_metrics_subword": _run_metrics(GRID),
    "tokenizer_comparison": _comparison(SHORT),
    "saved_model_score": saved_model_score,
    "epoch_records": _epoch_records(SHORT),
    "result_files": _result_files(SHORT),
    "curves": _curves(SHORT),
    "curve_summary": _curve_summary(SHORT),
}

# At the size of the reference, which SQL cannot repeat in a reasonable time.
FULL: dict[str, Query] = {
    "bpe_merges_full": _bpe_merges(None),
    "bpe_vocab_full": _bpe_vocab(None),
    "bpe_encode_full": _bpe_encoded("pretokenized", None),
    "bpe_encode_raw_full": _bpe_encoded("raw", None),
    "bpe_decode_full": _bpe_decoded(None),
    "unigram_seed_full": _unigram_seed(SEEDS),
    "tokenizer_comparison_full": _comparison(GRID),
    "epoch_records_full": _epoch_records(GRID),
    "result_files_full": _result_files(GRID),
    "curves_full": _curves(GRID),
}
