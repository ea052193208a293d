"""The run ledger, and the subword half of the grid against a plain evaluation."""

import json
import math
import threading
from collections import Counter

import pytest
from tokenizers import Tokenizer, models as lib, pre_tokenizers, trainers

import __spark_entry__
from glyphloom.functions.text import SPECIALS
from glyphloom.plans import ledger, tokenizers
from glyphloom.plans.experiment import Settings
from glyphloom.sources import corpus

SMALL = Settings(context=8, batch=4, epochs=2)


@pytest.fixture
def docs(spark):
    rows = [(("train", "val", "test")[n % 3], n, f"the cat {n % 7} sat, on the mat no. {n % 5}!")
            for n in range(90)]
    return spark.createDataFrame(rows, "split string, doc_id bigint, text string")


def test_nothing_is_made_twice(docs, tmp_path, monkeypatch):
    book = ledger.Ledger.of(docs, SMALL, str(tmp_path))
    first = book.run("bpe", 40)
    model = book.model(first, 40)
    rows = sorted(map(tuple, first.weighted.collect()))

    def never(*_):
        raise AssertionError("made again")

    for name in ("train_tokenizer", "prepare", "train_counts"):
        monkeypatch.setattr(ledger, name, never)
    again = ledger.Ledger.of(docs.repartition(7), SMALL, str(tmp_path))
    data = again.run("bpe", 40)
    assert sorted(map(tuple, data.weighted.collect())) == rows
    assert again.model(data, 40).pairs.count() == model.pairs.count()
    for other in (ledger.Ledger.of(docs.where("doc_id < 80"), SMALL, str(tmp_path)),
                  ledger.Ledger.of(docs, Settings(context=9, batch=4), str(tmp_path))):
        with pytest.raises(AssertionError):
            other.run("bpe", 40)
    with pytest.raises(AssertionError):
        again.run("bpe", 41)


def test_a_part_without_its_marker_is_made_again(docs, tmp_path, monkeypatch):
    book = ledger.Ledger.of(docs, SMALL, str(tmp_path))

    def cut_off(data, folder):
        ledger.models.save_vocab(data.vocab.limit(1), folder)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "save_tokenizer", cut_off)
        with pytest.raises(RuntimeError):
            book.tokenizer("word", 30)
    assert not book.done("word-30/tokenizer")
    assert book.tokenizer("word", 30).vocab_size > 4 and book.done("word-30/tokenizer")


def test_content_alone_decides_the_key(docs):
    mark = ledger.fingerprint(docs)
    assert mark == ledger.fingerprint(docs.repartition(5).orderBy("text"))
    assert mark != ledger.fingerprint(docs.union(docs.limit(1)))
    assert mark != ledger.fingerprint(docs.withColumn("split", ledger.F.lit("train")))
    assert ledger.fingerprint(docs.limit(0)).startswith("0-")


def _plain_run(streams, size, context, batch):
    """Add-k metrics of a split in its order of windows, from whole streams."""
    pairs = Counter(zip(streams["train"], streams["train"][1:]))
    heads = Counter(a for (a, _), n in pairs.items() for _ in range(n))
    out = {}
    for split, ids in streams.items():
        loss = [0.0] + [-math.log((pairs[p] + 1) / (heads[p[0]] + size)) for p in zip(ids, ids[1:])]
        sums = [0.0]
        for x in loss:
            sums.append(sums[-1] + x)
        windows = [(sums[s + context + 1] - sums[s + 1]) / context for s in range(len(ids) - context)]
        means = [sum(b) / len(b) for b in (windows[i:i + batch] for i in range(0, len(windows), batch))]
        out[split] = sum(means) / len(means)
    return out


def test_subword_runs_of_the_grid(spark, sf_dir):
    rows = sorted((r.doc_id, r.split, r.text) for r in corpus.read_documents(spark, sf_dir).collect())
    tokenizer = Tokenizer(lib.BPE(unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.train_from_iterator(
        [t.replace("\n", " ") for _, s, t in rows if s == "train"],
        trainers.BpeTrainer(vocab_size=5000, special_tokens=list(SPECIALS), show_progress=False))
    streams = {}
    for _, split, text in rows:
        streams.setdefault(split, [2]).extend(tokenizer.encode(text).ids)
    want = _plain_run({s: ids + [3] for s, ids in streams.items()},
                      len(json.loads(tokenizer.to_str())["model"]["vocab"]), 128, 32)
    found = __spark_entry__.queries()["run_metrics_subword"](spark, sf_dir).collect()
    assert {(r.tokenizer, r.scorer) for r in found} == {
        (t, s) for t in ("word", "byte", "bpe", "bpe-raw", "unigram")
        for s in ("addk", "interpolated")} and len(found) == 30
    got = {r.split: r.nll_token for r in found if (r.tokenizer, r.scorer) == ("bpe", "addk")}
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 2e-6 for s in want)
    short = __spark_entry__.queries()["run_metrics"](spark, sf_dir).collect()
    assert set(map(tuple, short)) == {tuple(r) for r in found if r.tokenizer in ("word", "byte")}
    files = __spark_entry__.queries()["result_files_full"](spark, sf_dir).collect()
    curves = __spark_entry__.queries()["curves_full"](spark, sf_dir).collect()
    assert len(files) == len(curves) == 50
    assert {(r.tokenizer, r.scorer, r.epoch, r.train_loss) for r in files} == {
        (r.tokenizer, r.scorer, r.epoch, r.train_loss) for r in curves}


def test_units_are_counted_once_for_all_subword_tokenizers(docs, tmp_path, monkeypatch):
    calls = []
    counted = ledger.unit_counts

    def once(*args):
        calls.append(args)
        return counted(*args)

    def never(*_):
        raise AssertionError("counted again")

    monkeypatch.setattr(ledger, "unit_counts", once)
    monkeypatch.setattr(tokenizers, "unit_counts", never)
    book = ledger.Ledger.of(docs, SMALL, str(tmp_path))
    made = [book.tokenizer(name, 40) for name in ("bpe", ledger.RAW, "unigram")]
    assert len(calls) == 1
    monkeypatch.undo()
    train = corpus.pick_split(docs, "train")
    for name, got in zip(("bpe", "bpe", "unigram"), made):
        alone = tokenizers.train_tokenizer(name, train, 40)
        assert sorted(got.vocab.collect()) == sorted(alone.vocab.collect())


def test_runs_of_a_grid_are_made_side_by_side():
    met = threading.Barrier(3)

    def make(name):
        met.wait(20)  # breaks unless all three are under way
        return name * 2

    assert list(ledger.side_by_side(make, "cab").items()) == [("c", "cc"), ("a", "aa"), ("b", "bb")]
    assert ledger.side_by_side(make, []) == {}
