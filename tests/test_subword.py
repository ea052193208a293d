"""BPE and unigram against the tokenizers package, and against plain greedy merging."""

import json
import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models as lib, pre_tokenizers, trainers

from glyphloom.functions import lattice
from glyphloom.functions.segment import best_path, digamma, merge_in_order, with_prefixes
from glyphloom.functions.text import SPECIALS
from glyphloom.operators import bpe, subword, unigram
from glyphloom.plans.tokenizers import bpe_tokenizer, unigram_tokenizer
from glyphloom.session import checkpointed
from glyphloom.sources import corpus, models


def _ids(df):
    return {r.doc_id: list(r.ids) for r in df.collect()}


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def _plain_tokens(tokenizer, ids):
    """Tokens by id, the special ones left out."""
    names = {i: t for t, i in tokenizer.get_vocab().items()}
    return " ".join(names[i] for i in ids if names[i] not in SPECIALS)


def _library_bpe(texts, size):
    tokenizer = Tokenizer(lib.BPE(unk_token="<unk>"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.train_from_iterator(texts, trainers.BpeTrainer(
        vocab_size=size, special_tokens=list(SPECIALS), show_progress=False))
    return tokenizer


def _greedy(units, size):
    """One merge at a time, counted afresh."""
    words = {tuple(u): n for u, n in units.items()}
    ids = {t: i for i, t in enumerate([*SPECIALS, *sorted({c for u in units for c in u})])}
    merges = []
    while len(ids) < size:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(w, w[1:]):
                counts[pair] += n
        if not counts:
            break
        a, b = min(counts, key=lambda p: (-counts[p], ids[p[0]], ids[p[1]]))
        merges.append((a, b))
        ids.setdefault(a + b, len(ids))
        merged = defaultdict(int)
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i:i + 2] == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            merged[tuple(out)] += n
        words = merged
    return merges


def _trained(spark, units, size, symbols=bpe.REGION_SYMBOLS):
    df = spark.createDataFrame(list(units.items()), "unit string, n bigint")
    return [(r.left, r.right) for r in bpe.bpe_train(df, size, symbols).merges.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return corpus.read_documents(spark, sf_dir)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def bpe_pair(docs, rows):
    """Our model and the library's, trained on the same corpus."""
    lines = [t.replace("\n", " ") for t in rows.values()]
    return bpe.bpe_train(subword.unit_counts(docs), 160), _library_bpe(lines, 160)


def test_merges_and_vocab_equal_the_library(bpe_pair):
    ours, theirs = bpe_pair
    merges = [(r.left, r.right) for r in ours.merges.orderBy("rank").collect()]
    assert merges == [tuple(m) for m in json.loads(theirs.to_str())["model"]["merges"]]
    assert {r.token: r.id for r in ours.vocab.collect()} == theirs.get_vocab()


@pytest.mark.parametrize("units", [
    {"aaaa": 50, "cd": 40}, {"aaa": 3, "abab": 5}, {"a": 9}, {"abc": 5, "bc": 5, "ab": 5},
    {"xabc": 4, "abc": 4, "bcx": 7, "aab": 6}], ids=str)
def test_self_pairs_and_overlaps(spark, units):
    assert _trained(spark, units, 40) == _greedy(units, 40)


def test_random_units_equal_greedy(spark):
    rng = random.Random(5)
    for symbols in (9, 25, 1000):
        units = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))):
                 rng.randrange(1, 30) for _ in range(12)}
        assert _trained(spark, units, 16, symbols) == _greedy(units, 16)


def _cut(word, live):
    """Longest stretches of live pairs."""
    runs, at = [], 0
    while at < len(word) - 1:
        end = at
        while end + 1 < len(word) and (word[end], word[end + 1]) in live:
            end += 1
        if end > at:
            runs.append(word[at:end + 1])
        at = max(end, at + 1)
    return runs


def test_rounds_of_any_floor_equal_greedy():
    """Whole training runs in rounds of random floors: regions cut, replayed, applied."""
    rng = random.Random(11)
    for _ in range(300):
        units = {"".join(rng.choice("abcdefgh"[:rng.randrange(2, 9)]) for _ in range(
            rng.randrange(1, 10))): rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randrange(1, 25))}
        ids = {t: i for i, t in enumerate([*SPECIALS, *sorted({c for u in units for c in u})])}
        words, merges, size = [([ids[c] for c in u], n) for u, n in units.items()], [], 60
        while len(ids) < size:
            counts = Counter()
            for w, n in words:
                for pair in zip(w, w[1:]):
                    counts[pair] += n
            if not counts:
                break
            floor = rng.choice([1, max(counts.values()), rng.randrange(1, max(counts.values()) + 1)])
            live = {p for p, n in counts.items() if n >= floor}
            regions = [(r, n) for w, n in words for r in _cut(w, live)]
            steps, names = bpe.replay(regions, floor, ids, size), list(ids)
            for a, b in steps:
                merges.append((names[a], names[b]))
                if names[a] + names[b] not in ids:
                    ids[names[a] + names[b]] = len(ids)
                    names.append(names[a] + names[b])
            if floor == 1:
                break
            rules = {p: (k, ids[names[p[0]] + names[p[1]]]) for k, p in enumerate(steps)}
            words = [(merge_in_order(w, rules), n) for w, n in words]
        assert merges == _greedy(units, size)


def test_marks_avoid_characters_in_use(spark):
    units = {"abab": 3, "cd": 2}
    assert _trained(spark, units, 12) == _greedy(units, 12)


def test_encode_and_decode_equal_the_library(bpe_pair, docs, rows):
    ours, theirs = bpe_pair
    encoded = bpe.bpe_encode(docs, ours)
    got = _ids(encoded)
    assert got == {d: theirs.encode(t).ids for d, t in rows.items()}
    assert _texts(bpe.bpe_decode(encoded, ours)) == {
        d: _plain_tokens(theirs, ids) for d, ids in got.items()}


def test_raw_mode_equals_the_reloaded_library(bpe_pair, docs, rows, tmp_path):
    ours, theirs = bpe_pair
    theirs.model.save(str(tmp_path))
    loaded = Tokenizer(lib.BPE.from_file(str(tmp_path / "vocab.json"),
                                         str(tmp_path / "merges.txt"), unk_token="<unk>"))
    tokenizer = bpe_tokenizer(replace(ours, mode="raw"))
    encoded = tokenizer.encode(docs)
    got = _ids(encoded)
    assert got == {d: loaded.encode(f"<bos> {t} <eos>").ids for d, t in rows.items()}
    assert _texts(tokenizer.decode(encoded, skip_specials=False)) == {
        d: loaded.decode(ids, skip_special_tokens=False) for d, ids in got.items()}


def test_special_tokens_inside_text(bpe_pair, make_docs):
    ours, theirs = bpe_pair
    texts = ["(<bos> a<unk>b <pad", "<eos><eos>", "x <pad>.", ""]
    assert _ids(bpe.bpe_encode(make_docs(texts), ours)) == {
        i: theirs.encode(t).ids for i, t in enumerate(texts)}


def test_save_and_load_bpe(spark, bpe_pair, make_docs, tmp_path):
    path = str(tmp_path / "bpe")
    models.save_bpe(bpe_pair[0], path)
    docs = make_docs(["the cat, the hat"])
    assert _ids(bpe.bpe_encode(docs, models.load_bpe(spark, path))) == _ids(
        bpe.bpe_encode(docs, bpe_pair[0]))
    assert models.load_bpe(spark, path, "raw").mode == "raw"
    with pytest.raises(ValueError):
        models.load_unigram(spark, path)
    with pytest.raises(ValueError):
        replace(bpe_pair[0], mode="other")


def test_encoding_and_decoding_move_no_rows(bpe_pair, docs):
    scan = docs.sparkSession.createDataFrame(docs.limit(3).collect(), docs.schema)
    encoded = bpe.bpe_encode(scan, bpe_pair[0])
    for df in (encoded, bpe.bpe_decode(encoded, bpe_pair[0])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def unigram_pair(docs):
    """Our model, and the library's model holding the same pieces."""
    ours = unigram.unigram_train(subword.unit_counts(docs), 300, 1200)
    pieces = [(r.piece, r.log_prob) for r in ours.pieces.orderBy("id").collect()]
    theirs = Tokenizer(lib.Unigram(pieces, unk_id=1))
    theirs.pre_tokenizer = pre_tokenizers.Whitespace()
    theirs.add_special_tokens(list(SPECIALS))
    return ours, theirs


def test_unigram_segmentation_equals_the_library(unigram_pair, docs, rows):
    ours, theirs = unigram_pair
    encoded = unigram.unigram_encode(docs, ours)
    got = _ids(encoded)
    assert got == {d: theirs.encode(t).ids for d, t in rows.items()}
    assert _texts(unigram.unigram_decode(encoded, ours)) == {
        d: _plain_tokens(theirs, ids) for d, ids in got.items()}


def test_unigram_unknown_runs(unigram_pair, make_docs):
    ours, theirs = unigram_pair
    texts = ["日本語 the 日本", "日the日", "", "😀!😀 <unk> a"]
    assert _ids(unigram.unigram_encode(make_docs(texts), ours)) == {
        i: theirs.encode(t).ids for i, t in enumerate(texts)}


def test_unigram_model_shape(spark, unigram_pair, docs, tmp_path):
    ours, _ = unigram_pair
    rows = ours.pieces.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(300)) and ours.vocab_size == 300
    assert [r.piece for r in rows[:4]] == list(SPECIALS)
    scores = [r.log_prob for r in rows[4:]]
    assert scores == sorted(scores, reverse=True) and max(scores) < 0
    letters = {r.token for r in subword.alphabet(subword.unit_counts(docs)).collect()}
    assert letters <= {r.piece for r in rows}
    path = str(tmp_path / "unigram")
    models.save_unigram(ours, path)
    assert models.load_unigram(spark, path).pieces.orderBy("id").collect() == rows


def test_unigram_compresses_like_the_library(unigram_pair, docs, rows):
    lines = [t.replace("\n", " ") for t in rows.values()]
    theirs = Tokenizer(lib.Unigram())
    theirs.pre_tokenizer = pre_tokenizers.Whitespace()
    theirs.train_from_iterator(lines, trainers.UnigramTrainer(
        vocab_size=300, special_tokens=list(SPECIALS), unk_token="<unk>", show_progress=False))
    want = sum(len(theirs.encode(t).ids) for t in rows.values())
    got = sum(len(i) for i in _ids(unigram.unigram_encode(docs, unigram_pair[0])).values())
    assert got < 1.03 * want


def _all_splits(unit):
    if not unit:
        yield []
    for k in range(1, len(unit) + 1):
        for rest in _all_splits(unit[k:]):
            yield [unit[:k], *rest]


def _lattice(units, scores):
    pieces = sorted(scores)
    automaton = lattice.Automaton.of(pieces)
    return pieces, np.array([scores[p] for p in pieces]), automaton.lattice(units)


def _expected(units, weights, scores):
    pieces, costs, found = _lattice(units, scores)
    into = np.zeros(len(pieces))
    found.expected(costs, np.array(weights, float), into)
    return dict(zip(pieces, into.tolist()))


def _plain_expected(unit, weight, scores):
    logs = {tuple(s): sum(scores[p] for p in s)
            for s in _all_splits(unit) if all(p in scores for p in s)}
    best, want = max(logs.values()), Counter()
    total = sum(math.exp(v - best) for v in logs.values())
    for split, v in logs.items():
        for piece in split:
            want[piece] += weight * math.exp(v - best) / total
    return want, best


@pytest.mark.parametrize("scale", [1, 40])
def test_expected_uses_and_best_paths_against_all_splits(scale):
    """Large scales leave the range of doubles and are redone in logarithms."""
    rng = random.Random(scale)
    for _ in range(25):
        letters = "abç日"[:rng.randrange(1, 5)]
        scores = {c: -rng.random() * 6 * scale for c in letters}
        for _ in range(8):
            scores["".join(rng.choice(letters) for _ in range(rng.randrange(2, 6)))] = \
                -rng.random() * 9 * scale
        units = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 11)))
                 for _ in range(12)]
        weights = [rng.randrange(1, 9) for _ in units]
        plain = [_plain_expected(u, n, scores) for u, n in zip(units, weights)]
        want = sum((p[0] for p in plain), Counter())
        got = _expected(units, weights, scores)
        assert all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-9) for p in scores)
        pieces, costs, found = _lattice(units, scores)
        total, back = found.best(costs)
        assert np.allclose(total[found.first[1:] - 1], [p[1] for p in plain])
        used = np.zeros(len(pieces))
        found.used(costs, np.array(weights, float), used)
        known, paths = with_prefixes(scores), Counter()
        for unit, n in zip(units, weights):
            spans, best = best_path(unit, known, -1e9)
            assert math.isclose(best, total[found.first[units.index(unit) + 1] - 1])
            for a, b in spans:
                paths[unit[a:b]] += n
        assert dict(zip(pieces, used.tolist())) == {p: float(paths[p]) for p in pieces}


def test_lattices_of_long_uncovered_and_empty_units():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.2, "aba": -4.0}
    long = _expected(["ab" * 20_000, "a", "", "axb"], [2, 1, 5, 7], scores)
    assert math.isclose(sum(len(p) * n for p, n in long.items()), 80_001, rel_tol=1e-6)
    assert _expected([], [], scores) == dict.fromkeys(scores, 0.0)
    assert _lattice(["xyz", ""], {})[2].best(np.empty(0))[0].tolist()[0] == 0.0
    pieces, costs, found = _lattice(["ab", "aba"], scores)
    split = found.without(found.whole()).best(costs)[0][found.first[1:] - 1]
    assert split.tolist() == [-4.5, -5.0]


def test_lattice_columns_are_sorted_by_digits(monkeypatch):
    # Wide columns are sorted by comparing, several times slower; both give one order.
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.25, "aab": -3.0}
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **k: sorts.append(x.dtype) or plain(x, **k))
    _, costs, found = _lattice(["ab" * 20, "ba", ""], scores)
    uses = np.zeros(len(costs))
    found.expected(costs, np.ones(3), uses)
    assert sorts == [np.uint16]
    monkeypatch.setattr(lattice, "_narrow", lambda values, top: values)
    wide = np.zeros(len(costs))
    found.expected(costs, np.ones(3), wide)
    assert uses.tolist() == wide.tolist()


def test_the_automaton_finds_exactly_its_pieces():
    rng = random.Random(2)
    pieces = sorted({"".join(rng.choice("abcdeé日😀") for _ in range(rng.randrange(1, 8)))
                     for _ in range(3000)})
    units = ["".join(rng.choice("abcdeé日😀x") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    found = lattice.Automaton.of(pieces).lattice(units)
    unit = np.searchsorted(found.first, found.start, side="right") - 1
    got = Counter((int(u), int(o), pieces[p]) for u, o, p in zip(unit, found.offset, found.piece))
    known = set(pieces)
    want = Counter((u, a, t[a:b]) for u, t in enumerate(units) for a in range(len(t))
                   for b in range(a + 1, min(a + 8, len(t)) + 1) if t[a:b] in known)
    assert got == want


def test_seeds_are_all_repeated_substrings(spark):
    rng = random.Random(4)
    units = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 25))): rng.randrange(1, 4)
             for _ in range(80)}
    want = Counter()
    for unit, n in units.items():
        for a in range(len(unit)):
            for b in range(a + 2, min(a + 16, len(unit)) + 1):
                want[unit[a:b]] += n
    df = spark.createDataFrame(list(units.items()), "unit string, n bigint").repartition(5)
    got = [(r.piece, r.n, r.score) for r in unigram.substring_seed(df, 10_000).collect()]
    assert got == sorted(((p, n, n * len(p)) for p, n in want.items() if n > 1),
                         key=lambda r: (-r[2], r[0]))


def test_digamma():
    assert abs(digamma(1.0) + 0.5772156649015329) < 1e-9
    assert abs(digamma(10.0) - 2.251752589066721) < 1e-9


def test_unit_counts_are_independent_of_partitions(make_docs):
    texts = ["a,b a", "", "b--b", "a"] * 5
    seen = [sorted(subword.unit_counts(make_docs(texts, parts=p)).collect()) for p in (1, 4, 13)]
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("train", [bpe.bpe_train, unigram.unigram_train])
def test_training_tasks_do_not_follow_the_shuffle_partitions(spark, train):
    texts = [(f"{a}{b}{c}", 1 + len(a)) for a in ("un", "re", "over") for b in (
        "do", "read", "write", "train") for c in ("ing", "er", "able", "s")]
    units = spark.createDataFrame(texts, "unit string, n bigint").groupBy("unit").agg(
        F.sum("n").alias("n"))
    tracker, found = spark.sparkContext.statusTracker(), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (2, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        group = f"{train.__name__}-{parts}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            model = train(checkpointed(units), 60)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            spark.conf.set("spark.sql.shuffle.partitions", before)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
        found.append((sorted(model.vocab.collect()), len(jobs),
                      max(s.numTasks for s in stages if s)))
    assert found[0][0] == found[1][0]
    assert found[1][1] <= found[0][1] + 5
    assert found[1][2] < 60
