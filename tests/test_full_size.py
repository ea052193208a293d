"""The registered subword queries at their full size, against the tokenizers package."""

import json

import pytest
from tokenizers import Tokenizer, models as lib, pre_tokenizers, trainers

import __spark_entry__
from glyphloom.functions.text import SPECIALS
from glyphloom.operators import bpe, subword
from glyphloom.sources import corpus

SIZE = 5000


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r.doc_id: r.text for r in corpus.read_documents(spark, sf_dir).collect()}


@pytest.fixture(scope="module")
def library(rows):
    tokenizer = Tokenizer(lib.BPE(unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.train_from_iterator(
        [t.replace("\n", " ") for t in rows.values()],
        trainers.BpeTrainer(vocab_size=SIZE, special_tokens=list(SPECIALS), show_progress=False))
    return tokenizer


def _query(name, spark, sf_dir):
    return __spark_entry__.queries()[name](spark, sf_dir).collect()


def test_merges(library, spark, sf_dir):
    got = sorted((r["rank"], r.left, r.right) for r in _query("bpe_merges_full", spark, sf_dir))
    assert [m[1:] for m in got] == [
        tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]


def test_vocab(library, spark, sf_dir):
    got = _query("bpe_vocab_full", spark, sf_dir)
    assert {r.token: r.id for r in got} == library.get_vocab() and len(got) == SIZE


def test_ids(library, rows, spark, sf_dir):
    got = {r.doc_id: r.ids for r in _query("bpe_encode_full", spark, sf_dir)}
    assert got == {d: " ".join(map(str, library.encode(t).ids)) for d, t in rows.items()}


def test_ids_as_loaded(library, rows, spark, sf_dir, tmp_path):
    library.model.save(str(tmp_path))
    loaded = Tokenizer(lib.BPE.from_file(str(tmp_path / "vocab.json"),
                                         str(tmp_path / "merges.txt"), unk_token="<unk>"))
    got = {r.doc_id: r.ids for r in _query("bpe_encode_raw_full", spark, sf_dir)}
    assert got == {d: " ".join(map(str, loaded.encode(t).ids)) for d, t in rows.items()}


def test_texts(library, rows, spark, sf_dir):
    names = {i: t for t, i in library.get_vocab().items()}
    got = {r.doc_id: r.text for r in _query("bpe_decode_full", spark, sf_dir)}
    assert got == {d: " ".join(names[i] for i in library.encode(t).ids if i >= len(SPECIALS))
                   for d, t in rows.items()}


@pytest.mark.parametrize("symbols", [3_000, 60_000])
def test_many_rounds(library, rows, make_docs, symbols):
    """The same merges when a round brings only small regions to the driver."""
    units = subword.unit_counts(make_docs(list(rows.values()), parts=5))
    got = bpe.bpe_train(units, 700, symbols).merges.orderBy("rank").collect()
    assert [(r.left, r.right) for r in got] == [
        tuple(m) for m in json.loads(library.to_str())["model"]["merges"]][:len(got)]
    assert len(got) > 500
