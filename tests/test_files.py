"""Models in the file forms of other programs, both ways."""

from tokenizers import Tokenizer, models as lib

from glyphloom.operators import bpe, subword, unigram
from glyphloom.plans.tokenizers import bpe_tokenizer, word_tokenizer
from glyphloom.sources import corpus, files


def _ids(df):
    return {r.doc_id: list(r.ids) for r in df.collect()}


def test_word_vocabulary(spark, make_docs, tmp_path):
    from glyphloom.operators.word import word_vocab

    docs = make_docs(['b "é" a', "a b c"])
    vocab = word_vocab(docs, 9)
    files.save_vocab_json(vocab, str(tmp_path))
    loaded = files.load_vocab_json(spark, str(tmp_path))
    assert sorted(loaded.collect()) == sorted(vocab.collect())
    assert _ids(word_tokenizer(loaded).encode(docs)) == _ids(word_tokenizer(vocab).encode(docs))


def test_bpe_files_load_in_the_library(spark, sf_dir, make_docs, tmp_path):
    docs = corpus.read_documents(spark, sf_dir).limit(20)
    model = bpe.bpe_train(subword.unit_counts(docs), 90)
    files.save_bpe_files(model, str(tmp_path))
    theirs = Tokenizer(lib.BPE.from_file(str(tmp_path / "vocab.json"),
                                         str(tmp_path / "merges.txt"), unk_token="<unk>"))
    loaded = files.load_bpe_files(spark, str(tmp_path))
    assert sorted(loaded.vocab.collect()) == sorted(model.vocab.collect())
    assert sorted(loaded.merges.collect()) == sorted(model.merges.collect())
    texts = ["The # version and other\nwords", "é"]
    assert _ids(bpe_tokenizer(loaded).encode(make_docs(texts), add_specials=False)) == {
        i: theirs.encode(t).ids for i, t in enumerate(texts)}


def test_unigram_file_loads_in_the_library(spark, make_docs, tmp_path):
    pieces = [("<pad>", 0.0), ("<unk>", 0.0), ("<bos>", 0.0), ("<eos>", 0.0), ("th", -1.5),
              ("t", -3.0), ("h", -3.0), ("e", -2.0), ("the", -2.2)]
    model = unigram.UnigramModel(spark.createDataFrame(
        [(i, *p) for i, p in enumerate(pieces)], "id int, piece string, log_prob double"), 9)
    files.save_unigram_json(model, str(tmp_path))
    theirs = Tokenizer.from_file(str(tmp_path / "tokenizer.json"))
    loaded = files.load_unigram_json(spark, str(tmp_path))
    assert loaded.vocab_size == 9
    texts = ["the het <unk> x", "thet e"]
    assert _ids(unigram.unigram_encode(make_docs(texts), loaded)) == {
        i: theirs.encode(t).ids for i, t in enumerate(texts)}
