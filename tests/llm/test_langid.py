import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glyphloom.llm import langid, queries
from tests.llm.conftest import ODD, words


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def plain(rows, texts, order):
    """Code lengths by following the escapes of every byte, one language at a time."""
    after = defaultdict(lambda: defaultdict(Counter))

    def code(text):
        return b" " * order + text.encode().translate(langid._FOLD)

    for lang, text in rows:
        data = code(text)
        for i in range(order, len(data)):
            for k in range(order + 1):
                after[lang][data[i - k:i]][data[i]] += 1
    out = []
    for text in texts:
        data, lengths = code(text), []
        for lang in sorted(after):
            total = 0.0
            for i in range(order, len(data)):
                for k in range(order, -1, -1):
                    seen = after[lang].get(data[i - k:i])
                    if seen is None:
                        continue
                    all_ = sum(seen.values()) + len(seen)
                    if seen[data[i]]:
                        total -= math.log2(seen[data[i]] / all_)
                        break
                    del seen[data[i]]
                    total -= math.log2(len(seen) / all_)
                else:
                    total += 8
            lengths.append(total)
        out.append(lengths)
    return np.array(out)


ROWS = [("aa", words(1, 60)), ("bb", "und das ist der Text über Größe\nund Maß " * 3),
        ("aa", "Another, shorter one."), ("cc", "один два три четыре пять"), ("aa", "x"), ("cc", "")]
TEXTS = [words(2, 30), "der Text über das Maß", "три один", "QQQ zz 77 \u0001", "", "x", "日本語",
         words(1, 60) + " Größe"]


@pytest.fixture
def sample(spark):
    # Ids outside the held-out fold.
    ids = [i for i in range(100) if fold(i)]
    return spark.createDataFrame([(i, *r) for i, r in zip(ids, ROWS)],
                                 "doc_id bigint, lang string, text string")


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_equal_brute_force(sample, order, monkeypatch):
    want = plain(ROWS, TEXTS, order)
    model = langid.train(sample, order=order)
    assert model.languages == ["aa", "bb", "cc"]
    for piece in (7, 64, 1 << 19):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.allclose(model.lengths([t.encode() for t in TEXTS]), want)


def test_probabilities_never_exceed_one(sample):
    """All bytes that may follow a context, known to some language or to none."""
    model = langid.train(sample, order=2)
    for front in (b"  ", b"th", b"e ", b"\xd1\x82", b"zz"):
        bits = np.array([model.bits(np.frombuffer(front + bytes([b]), np.uint8))[0]
                         for b in range(256)])
        assert (np.exp2(-bits).sum(0) <= 1 + 1e-9).all()


def test_look_up_is_exact():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 40, 5000).astype(np.uint64))
    find = langid.Numbers(keys)
    assert (find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(draw.integers(0, 1 << 40, 5000).astype(np.uint64), keys)
    assert (find(other) == -1).all()
    assert (langid.Numbers(keys[:0])(other) == -1).all()


def test_odd_rows(frame, monkeypatch, spark):
    rows = ODD + [(20 + n, words(n, 40)) for n in range(8)] + [(40, "12 - 3"), (41, "é"), (42, "a")]
    monkeypatch.setattr(queries, "table", lambda *_: frame(rows))
    got = queries.op12_partial_matching(spark, "").collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.held_out) for r in got if r.doc_id is not None) == sorted(
        (d, fold(d) == 0) for d, _ in rows if d is not None)
    named = {r.doc_id: r for r in got if r.doc_id not in (None, 7)}
    assert [named[d].lang_pred for d in (1, 2, 3, 40, 41, 42)] == ["und"] * 4 + ["en"] * 2
    assert named[1].score == 0 and named[42].score == 1


def test_no_language_and_empty_table(frame):
    df = frame([(1, "some text"), (2, None)])
    model = langid.train(df.withColumn("lang", langid.F.lit(None).cast("string")))
    assert {(r.id, r.lang_pred, r.score) for r in langid.identify(df, model).collect()} == {
        (1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(frame([]), langid.train(frame([]))).collect() == []


def test_repeated_rows_do_not_fill_the_sample(spark):
    ids = [i for i in range(400) if fold(i)][:60]
    rows = [(ids[0], "aa", "zz zz")] * 500 + [(i, "aa", words(i, 12)) for i in ids[1:]]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"),
                         per_lang=40)
    assert len(model.costs[4]) > 500


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = docs.join(queries.op12_partial_matching(spark, sf_dir), "doc_id").where(
        "held_out AND lang_pred <> 'und'").collect()
    right = np.mean([r.lang == r.lang_pred for r in found])
    assert len(found) > 150 and right > 0.97
    wrong = [r for r in found if r.lang != r.lang_pred]
    assert np.mean([len(r.text) for r in wrong] or [0]) < 2500
