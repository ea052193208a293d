"""Next-token models, run metrics, sinks and comparison."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphloom.functions.metrics import METRICS, metric_columns
from glyphloom.operators import ngram
from glyphloom.plans import compare, experiment
from glyphloom.plans.tokenizers import byte_tokenizer, train_tokenizer
from glyphloom.sources import corpus, models, runs

SETTINGS = experiment.Settings(context=16, batch=8, epochs=3)


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    docs = corpus.read_documents(spark, sf_dir)
    word = train_tokenizer("word", corpus.pick_split(docs, "train"), 60)
    return {"word": experiment.prepare(docs, word, SETTINGS),
            "byte": experiment.prepare(docs, byte_tokenizer(spark), SETTINGS)}


def _pairs(spark, counts):
    return spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()],
                                 "prev int, cur int, n bigint")


TRAIN = Counter({(2, 4): 3, (4, 5): 2, (4, 4): 1, (5, 3): 2})
V = 6


def _prob(kind, prev, cur, k=1.0, share=0.75):
    n_prev = sum(n for (a, _), n in TRAIN.items() if a == prev)
    if kind == "addk":
        return (TRAIN[prev, cur] + k) / (n_prev + k * V)
    n_cur = sum(n for (_, b), n in TRAIN.items() if b == cur)
    unigram = (n_cur + k) / (sum(TRAIN.values()) + k * V)
    return share * (TRAIN[prev, cur] / n_prev if n_prev else 0.0) + (1 - share) * unigram


@pytest.mark.parametrize("kind", ngram.KINDS)
def test_scores_and_smoothing_against_all_words(spark, kind):
    model = ngram.fit(_pairs(spark, TRAIN), V)
    asked = Counter({(a, b): 1 for a in range(V) for b in range(V)})
    rows = ngram.score(model, _pairs(spark, asked), kind).collect()
    assert len(rows) == V * V
    for r in rows:
        assert math.isclose(r.nll, -math.log(_prob(kind, r.prev, r.cur)), rel_tol=1e-12)
    for prev in range(V):
        assert math.isclose(sum(_prob(kind, prev, c) for c in range(V)), 1.0) or (
            kind == "interpolated" and prev not in {a for a, _ in TRAIN})
    held = Counter({(4, 5): 2, (1, 4): 1, (4, 0): 5})
    loss = ngram.smoothed_loss(model, _pairs(spark, held).withColumnRenamed("n", "weight"), kind).first().train_loss
    want = sum(n * (0.9 * -math.log(_prob(kind, a, b)) + 0.1 * sum(
        -math.log(_prob(kind, a, c)) for c in range(V)) / V)
        for (a, b), n in held.items() if b != 0) / 3
    assert math.isclose(loss, want, rel_tol=1e-12)


def test_pad_targets_do_not_count(spark):
    model = ngram.fit(_pairs(spark, TRAIN), V)
    pairs = _pairs(spark, {(4, 5): 1, (4, 0): 9}).withColumns(
        {"split": F.lit("val"), "weight": F.lit(0.1)})
    row = ngram.mean_losses(ngram.score(model, pairs)).first()
    assert row.n_targets == 1 and math.isclose(row.nll_token, -math.log(_prob("addk", 4, 5)))


def test_stages_accumulate(spark):
    rows = [(0, 2, 4, 1), (1, 2, 4, 2), (2, 4, 5, 2)]
    model = ngram.fit_stages(spark.createDataFrame(
        rows, "slice int, prev int, cur int, n bigint"), V, 3)
    got = {(r.stage, r.prev, r.cur): r.n for r in model.pairs.collect()}
    assert got == {(0, 2, 4): 1, (1, 2, 4): 3, (2, 2, 4): 3, (2, 4, 5): 2}


def test_unknown_names(spark, data):
    with pytest.raises(ValueError, match="unknown model type"):
        experiment.run_metrics(data["word"], "lstm")
    with pytest.raises(ValueError, match="unknown split"):
        experiment.run_metrics(data["word"], "addk", ("dev",))
    with pytest.raises(ValueError, match="unknown split"):
        corpus.pick_split(spark.range(1), "dev")


def test_metric_identities(spark, data):
    found = compare.all_runs(data)
    rows = found.collect()
    assert len(rows) == 2 * 2 * 3
    for r in rows:
        assert math.isclose(r.perplexity, math.exp(r.nll_token))
        assert math.isclose(r.bits_per_token, r.nll_token / math.log(2))
        assert math.isclose(r.nll_per_char, r.nll_token * r.tokens_per_char)
        assert math.isclose(r.bits_per_char, r.nll_per_char / math.log(2))
        assert r.bits_per_byte <= r.bits_per_char
    wide = {r.tokenizer: r for r in compare.comparison(found).collect()}
    test = {(r.tokenizer, r.scorer): r for r in rows if r.split == "test"}
    for (tokenizer, scorer), r in test.items():
        for m in METRICS:
            assert wide[tokenizer][f"{scorer}_{m}"] == pytest.approx(r[m], rel=1e-12)


def test_saved_counts_score_the_asked_split(spark, data, tmp_path):
    path = str(tmp_path / "counts")
    models.save_counts(experiment.train_counts(data["word"]), path)
    direct = {r.split: r for r in experiment.run_metrics(data["word"], "addk").collect()}
    for split in corpus.SPLITS:
        rows = experiment.evaluate_saved(spark, path, data["word"], "addk",
                                         split).collect()
        assert [r.split for r in rows] == [split]
        assert rows[0].nll_token == pytest.approx(direct[split].nll_token, rel=1e-12)


def test_epochs(data):
    records = experiment.epoch_records(data["word"], "addk")
    rows = sorted(records.collect(), key=lambda r: r.epoch)
    assert [r.epoch for r in rows] == [0, 1, 2] and {r.split for r in rows} == {"val"}
    assert all(r.lr is None and r.val_loss == r.nll_token for r in rows)
    final = experiment.run_metrics(data["word"], "addk", ("val",)).first()
    assert rows[-1].nll_token == pytest.approx(final.nll_token, rel=1e-12)
    summary = compare.curve_summary(records).first()
    losses = [x for r in rows for x in (r.train_loss, r.val_loss)]
    assert (summary.n_epochs, summary.low, summary.high) == (3, min(losses), max(losses))


def test_run_sink_replaces_single_runs(spark, data, tmp_path):
    path = str(tmp_path / "runs")
    for kind in ngram.KINDS:
        runs.write_runs(experiment.epoch_records(data["word"], kind), path)
    runs.write_runs(experiment.epoch_records(data["word"], "addk")
                    .where("epoch = 0"), path)
    got = Counter((r.tokenizer, r.scorer) for r in runs.read_runs(spark, path).collect())
    assert got == {("word", "addk"): 1, ("word", "interpolated"): 3}
    record = experiment.test_record(data["word"], "addk")
    runs.write_runs(record, str(tmp_path / "test"))
    back = runs.read_runs(spark, str(tmp_path / "test"), test=True).first()
    assert back.split == "test" and back.nll_token == pytest.approx(record.first().nll_token)


def test_result_files_of_either_form(spark, tmp_path):
    full = dict(epoch=0, split="val", train_loss=1.5, val_loss=2.0, lr=0.1,
                **{m: 1.0 for m in METRICS})
    old = {k: v for k, v in full.items() if k not in ("split", "bits_per_byte")}
    (tmp_path / "metrics_word_addk.json").write_text(json.dumps(
        [full, dict(full, epoch=1)], indent=2))
    (tmp_path / "metrics_byte_addk.json").write_text(json.dumps([old], indent=2))
    (tmp_path / "test_metrics_word_addk.json").write_text(json.dumps(
        {m: 3.0 for m in METRICS} | {"split": "test"}, indent=2))
    rows = runs.read_result_files(spark, str(tmp_path)).collect()
    assert Counter((r.tokenizer, r.scorer) for r in rows) == {
        ("word", "addk"): 2, ("byte", "addk"): 1}
    byte = next(r for r in rows if r.tokenizer == "byte")
    assert byte.bits_per_byte is None and byte.split is None and byte.train_loss == 1.5
    test = runs.read_result_files(spark, str(tmp_path), test=True).collect()
    assert [(r.tokenizer, r.scorer, r.nll_token) for r in test] == [("word", "addk", 3.0)]
    ordered = [r.epoch for r in compare.curves(runs.read_result_files(
        spark, str(tmp_path)).where("tokenizer = 'word'")).collect()]
    assert ordered == [0, 1]


def test_run_grid(spark):
    assert compare.run_grid(spark).count() == 8


def test_metric_formulas(spark):
    row = spark.range(1).select(*metric_columns(
        F.lit(2.0), F.lit(30), F.lit(100), F.lit(120))).first()
    assert row.tokens_per_char == 0.3 and row.nll_per_char == 0.6
    assert math.isclose(row.bits_per_byte, 2.0 * 30 / 120 / math.log(2))


def test_first_rows_and_splits(spark, make_docs):
    docs = make_docs(["x"] * 20, parts=4)
    assert sorted(r.doc_id for r in corpus.first_rows(docs, 5).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="fewer than 21 rows"):
        corpus.first_rows(docs, 21).collect()
    split = {r.doc_id: r.split for r in corpus.seeded_split(docs).collect()}
    assert split == {r.doc_id: r.split for r in corpus.seeded_split(docs.repartition(7)).collect()}
    assert split != {r.doc_id: r.split for r in corpus.seeded_split(docs, 0.5).collect()}


def test_corpus_lines_round_trip(spark, make_docs, tmp_path):
    path = str(tmp_path / "corpus")
    corpus.write_corpus(make_docs(["a\nb", "", "é 😀", "r\rn\r\n"]), path)
    assert sorted(r.value for r in corpus.read_corpus(spark, path).collect()) == sorted(
        ["a b", "", "é 😀", "r\rn\r "])
