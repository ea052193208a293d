"""Word and byte tokenizers on hand fixtures."""

from collections import Counter

import pytest

from glyphloom.operators import word
from glyphloom.plans.tokenizers import byte_tokenizer, train_tokenizer, word_tokenizer
from glyphloom.sources import models


def _vocab(df):
    return [r.token for r in sorted(df.collect(), key=lambda r: r.id)]


def _ids(df):
    return {r.doc_id: list(r.ids) for r in df.collect()}


def test_ties_by_first_occurrence(make_docs):
    vocab = word.word_vocab(make_docs(["b a", "a b c"]), 6)
    assert _vocab(vocab) == ["<pad>", "<unk>", "<bos>", "<eos>", "b", "a"]


@pytest.mark.parametrize("size", [4, 5, 9, 40, 10_000])
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_vocab_equals_counter(make_docs, size, parts):
    texts = ["q w e r t y q", "z z a b c d e f g", "", "a b c d", "t y u i o p w w"] * 3
    counts = Counter(t for text in texts for t in text.split())
    want = ["<pad>", "<unk>", "<bos>", "<eos>"] + [t for t, _ in counts.most_common(size - 4)]
    assert _vocab(word.word_vocab(make_docs(texts, parts=parts), size)) == want


def test_too_small_vocab(make_docs):
    with pytest.raises(ValueError):
        word.word_vocab(make_docs(["a"]), 3)


def test_specials_in_text(make_docs):
    docs = make_docs(["<bos> a <unk> <pad>"])
    tokenizer = train_tokenizer("word", docs, 10)
    assert _vocab(tokenizer.vocab) == ["<pad>", "<unk>", "<bos>", "<eos>", "a"]
    assert _ids(tokenizer.encode(docs)) == {0: [2, 2, 4, 1, 0, 3]}


def test_encode_decode_and_empty_documents(make_docs):
    docs = make_docs(["  a  b\tc ", "", " ", "a z"])
    tokenizer = train_tokenizer("word", make_docs(["a b c"]), 10)
    encoded = tokenizer.encode(docs)
    assert _ids(encoded) == {0: [2, 4, 5, 6, 3], 1: [2, 3], 2: [2, 3], 3: [2, 4, 1, 3]}
    assert _ids(tokenizer.encode(docs, add_specials=False))[1] == []
    shown = {r.doc_id: r.text for r in tokenizer.decode(encoded).collect()}
    assert shown == {0: "a b c", 1: "", 2: "", 3: "a"}
    shown = {r.doc_id: r.text for r in tokenizer.decode(encoded, False).collect()}
    assert shown[3] == "<bos> a <unk> <eos>"


def test_decode_out_of_range(make_docs, make_encoded):
    tokenizer = train_tokenizer("word", make_docs(["a b"]), 10)
    for bad in (6, -1):
        with pytest.raises(Exception, match="out of range"):
            tokenizer.decode(make_encoded([[bad]])).collect()


def test_save_and_load(spark, make_docs, tmp_path):
    docs = make_docs(["b a", "a b c"])
    trained = train_tokenizer("word", docs, 10)
    models.save_vocab(trained.vocab, str(tmp_path / "w"))
    loaded = word_tokenizer(models.load_vocab(spark, str(tmp_path / "w")))
    assert _ids(loaded.encode(docs)) == _ids(trained.encode(docs))
    assert loaded.vocab_size == trained.vocab_size == 7


def test_byte_tokenizer(spark, make_docs, make_encoded):
    tokenizer = byte_tokenizer(spark)
    assert tokenizer.vocab_size == tokenizer.vocab.count() == 260
    docs = make_docs(["aé", ""])
    encoded = tokenizer.encode(docs)
    assert _ids(encoded) == {0: [2, 101, 199, 173, 3], 1: [2, 3]}
    assert {r.text for r in tokenizer.decode(encoded).collect()} == {"aé", ""}


def test_unknown_tokenizer(make_docs):
    with pytest.raises(ValueError, match="unknown tokenizer"):
        train_tokenizer("syllable", make_docs(["a"]))
