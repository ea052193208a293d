"""Streams, windows, batches and weights against lists."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.functions.metrics import target_weight
from glyphloom.operators import epoch, narrow, stream
from glyphloom.operators.stream import Joining

JOININGS = [Joining(), Joining(joint=(36,)), Joining((1, 54, 149), (1,), (1, 7))]


def _lists(seed, docs=60):
    rng = random.Random(seed)
    return [[rng.randrange(4, 9) for _ in range(rng.choice([0, 0, 1, 2, 5, 40]))]
            for _ in range(docs)]


def _stream(lists, j):
    out = list(j.prefix)
    for i, ids in enumerate(lists):
        out += (list(j.joint) if i else []) + ids
    return out + list(j.suffix)


def _laid_out(encoded, j):
    stored = stream.store_encoded(encoded)
    placed = stream.layout(stored, j).persist()
    return stored, placed, stream.segments(stored, placed, j)


@pytest.mark.parametrize("j", JOININGS, ids=str)
@pytest.mark.parametrize("parts", [1, 4, 13])
def test_positions_and_pairs(make_encoded, j, parts):
    lists = _lists(parts)
    want = _stream(lists, j)
    stored, placed, segs = _laid_out(make_encoded(lists, parts=parts), j)
    got = sorted((r.pos, r.id) for r in stream.stream_positions(segs).collect())
    assert got == list(enumerate(want))
    assert [r.length for r in stream.stream_lengths(stored, j).collect()] == [len(want)]
    pairs = {(r.prev, r.cur): r.n for r in stream.pair_counts(stored, j, placed).collect()}
    assert pairs == Counter(zip(want, want[1:]))


def test_all_documents_empty(make_encoded):
    stored, placed, segs = _laid_out(make_encoded([[], [], []]), Joining())
    assert sorted((r.pos, r.id) for r in stream.stream_positions(segs).collect()) == [
        (0, 2), (1, 3)]
    assert [(r.prev, r.cur, r.n) for r in stream.pair_counts(stored, Joining()).collect()] == [
        (2, 3, 1)]
    assert stream.next_token_windows(segs, 4).count() == 0


def test_one_document_is_first_and_last(make_encoded):
    stored, _, segs = _laid_out(make_encoded([[7]]), Joining())
    assert [r.seg for r in segs.collect()] == [[2, 7, 3]]


@pytest.mark.parametrize("j", JOININGS, ids=str)
@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_and_missing_ids(spark, j, parts):
    """A third of all documents has one id, a few have none; some rows are equal."""
    rng = random.Random(parts)
    lists = _lists(parts + 20, 90)
    rows = [("train", rng.choice([None, 7, 7, n, n, n]), ids) for n, ids in enumerate(lists)]
    rows += rows[:12]
    df = spark.createDataFrame(rows, "split string, doc_id bigint, ids array<int>")
    marks = {tuple(r.ids): r.m for r in df.select("ids", F.xxhash64("ids").alias("m")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, marks[tuple(r[2])]))
    want = _stream([r[2] for r in order], j)
    stored, placed, segs = _laid_out(df.repartition(parts), j)
    assert sorted((r.pos, r.id) for r in stream.stream_positions(segs).collect()) == list(
        enumerate(want))
    pairs = stream.pair_counts(stored, j, placed)
    assert {(r.prev, r.cur): r.n for r in pairs.collect()} == Counter(zip(want, want[1:]))
    found = stream.next_token_windows(segs, 16, 5, 32).collect()
    assert sorted((r.start, r.x) for r in found) == [
        (i, want[i:i + 16]) for i in range(0, len(want) - 16, 5)]
    weighted = stream.weighted_pairs(stored, j, placed, pairs, 16, 4).collect()
    loss = {(r.prev, r.cur): 1 + r.prev * 3 % 7 + r.cur for r in weighted}
    losses = [0.0] + [loss[p] for p in zip(want, want[1:])]
    assert math.isclose(sum(r.weight * loss[r.prev, r.cur] for r in weighted),
                        _reference_mean(losses, len(want), 16, 4), rel_tol=1e-9)


@pytest.mark.parametrize("context,stride,block", [
    (4, 1, 7), (4, 2, 7), (16, 5, 16), (30, 1, 8), (8, 3, 4096)])
def test_windows(make_encoded, context, stride, block):
    lists = _lists(11)
    want = _stream(lists, Joining())
    _, _, segs = _laid_out(make_encoded(lists, parts=4), Joining())
    rows = sorted(stream.next_token_windows(segs, context, stride, block).collect(),
                  key=lambda r: r.start)
    assert [r.start for r in rows] == list(range(0, len(want) - context, stride))
    for r in rows:
        assert r.x == want[r.start:r.start + context]
        assert r.y == want[r.start + 1:r.start + context + 1]


def test_ten_ids(make_encoded):
    _, _, segs = _laid_out(make_encoded([[4, 5, 6, 7, 8, 9, 10, 11]]), Joining())
    assert stream.next_token_windows(segs, 4, 1).count() == 6
    assert stream.next_token_windows(segs, 4, 2).count() == 3
    with pytest.raises(ValueError):
        stream.next_token_windows(segs, 4, 0)


def test_windows_do_not_hold_a_long_document_in_one_group(make_encoded):
    lists = [[5], list(range(4, 5004)), [6]]
    want = _stream(lists, Joining())
    _, _, segs = _laid_out(make_encoded(lists), Joining())
    rows = stream.next_token_windows(segs, 16, 16, block=64).collect()
    assert len(rows) == len(range(0, len(want) - 16, 16))
    assert all(r.x == want[r.start:r.start + 16] for r in rows)


def test_split_sizes(spark):
    lengths = spark.createDataFrame([("a", 39), ("b", 3), ("c", 36)], "split string, length bigint")
    got = {r.split: (r.n_windows, r.n_batches)
           for r in stream.split_sizes(lengths, 4, 32).collect()}
    assert got == {"a": (35, 2), "b": (0, 0), "c": (32, 1)}


@pytest.mark.parametrize("stride,chunk", [(1, 10), (3, 2), (3, 7), (2, 10_000)])
def test_window_starts(spark, stride, chunk):
    lengths = spark.createDataFrame([("a", 139), ("b", 3)], "split string, length bigint")
    got = sorted(r.start for r in stream.window_starts(lengths, 4, stride, chunk).collect())
    assert got == list(range(0, 135, stride))
    ordered = stream.ordered_batches(stream.window_starts(lengths, 4, stride, chunk), 8, stride)
    assert Counter(r.batch_id for r in ordered.collect()) == Counter(
        i // 8 for i in range(len(got)))


def test_shuffled_batches(spark):
    lengths = spark.createDataFrame([("a", 1039), ("b", 24), ("c", 3)], "split string, length bigint")
    starts, sizes = stream.window_starts(lengths, 4), stream.split_sizes(lengths, 4, 32)
    def batches(seed, number, df=starts):
        return {(r.split, r.start): r.batch_id for r in
                epoch.shuffled_batches(df, sizes, 32, seed, number).collect()}
    first = batches(1, 0)
    assert sorted(Counter(b for (s, _), b in first.items() if s == "a").values()) == [
        1035 % 32] + [32] * (1035 // 32)
    assert {k for k in first if k[0] == "b"} == {("b", i) for i in range(20)}
    assert batches(1, 0, starts.repartition(13)) == first
    assert batches(1, 1) != first and batches(2, 0) != first
    plan = epoch.shuffled_batches(spark.range(9).selectExpr("'a' split", "id start"), sizes, 32)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text and "Window" not in text


@pytest.mark.parametrize("count", [1, 7, 35, 1000])
def test_permutation_and_its_inverse(spark, count):
    numbers = spark.range(count).select("id", F.lit(count).alias("n"))
    for number in range(2):
        there = epoch.permuted(numbers, "id", "n", "place", 42, number)
        rows = epoch.permuted(there, "place", "n", "back", 42, number, back=True).collect()
        assert sorted(r.place for r in rows) == list(range(count))
        assert all(r.back == r.id for r in rows)
        assert all(epoch.moved(r.id, count, 42, number) == r.place for r in rows)
        assert all(epoch.moved(r.place, count, 42, number, back=True) == r.id for r in rows)
    if count >= 1000:
        # No trace of the old order: neighbours end up apart, as in random orders.
        near = sum(abs(a.place - b.place) < count / 20 for a, b in zip(rows, rows[1:]))
        assert near < count * 0.16


@pytest.mark.parametrize("j", JOININGS, ids=str)
@pytest.mark.parametrize("context,batch", [(4, 8), (16, 32), (7, 1), (30, 1000)])
def test_epoch_weights_against_materialised_batches(make_encoded, j, context, batch):
    lists = _lists(6)
    want = _stream(lists, j)
    stored, placed, segs = _laid_out(make_encoded(lists), j)
    sizes = stream.split_sizes(stream.stream_lengths(stored, j), context, batch)
    pairs = stream.pair_counts(stored, j, placed)
    uniform = stream.weighted_pairs(stored, j, placed, pairs, context, 1)
    last = epoch.last_batch_pairs(stored, placed, j, sizes, context, batch, 42, 2)
    weights = epoch.epoch_weights(uniform, last, sizes, context, batch).collect()
    loss = {p: math.log(2 + p[0] * 31 % 17 + p[1]) for p in zip(want, want[1:])}
    starts = stream.window_starts(stream.stream_lengths(stored, j), context)
    for number in range(2):
        held = {}
        for r in epoch.shuffled_batches(starts, sizes, batch, 42, number).collect():
            held.setdefault(r.batch_id, []).append(r.start)
        means = [sum(loss[want[s + i], want[s + i + 1]] for s in b for i in range(context))
                 / context / len(b) for b in held.values()]
        got = sum(w.weight * loss[w.prev, w.cur] for w in weights if w.epoch in (None, number))
        assert math.isclose(got, sum(means) / len(means), rel_tol=1e-9)


def _reference_mean(losses, length, context, batch):
    """Mean of batch means over windows; ``losses[p]`` belongs to target ``p``."""
    windows = [sum(losses[i + 1:i + 1 + context]) / context for i in range(length - context)]
    means = [sum(b) / len(b) for b in (windows[i:i + batch]
                                       for i in range(0, len(windows), batch))]
    return sum(means) / len(means)


@pytest.mark.parametrize("seed", range(3))
def test_target_weight_against_windows(spark, seed):
    rng = random.Random(seed)
    for _ in range(4):
        length, context, batch = rng.randrange(6, 120), rng.randrange(1, 12), rng.randrange(1, 9)
        if length <= context:
            continue
        losses = [0.0] + [rng.random() for _ in range(length - 1)]
        rows = spark.range(1, length).select("id", target_weight(
            F.col("id"), F.lit(length), context, batch).alias("w")).collect()
        assert math.isclose(sum(r.w for r in rows), 1.0, rel_tol=1e-12)
        got = sum(r.w * losses[r.id] for r in rows)
        assert math.isclose(got, _reference_mean(losses, length, context, batch), rel_tol=1e-9)


@pytest.mark.parametrize("j", JOININGS, ids=str)
@pytest.mark.parametrize("context,batch", [(4, 3), (16, 32), (300, 7)])
def test_weighted_pairs_against_windows(make_encoded, j, context, batch):
    lists = _lists(5)
    want = _stream(lists, j)
    stored, placed, _ = _laid_out(make_encoded(lists), j)
    pairs = stream.pair_counts(stored, j, placed)
    rows = stream.weighted_pairs(stored, j, placed, pairs, context, batch).collect()
    assert sum(r.n for r in rows) == len(want) - 1
    loss = {(r.prev, r.cur): math.log(2 + r.prev * 31 % 17 + r.cur) for r in rows}
    losses = [0.0] + [loss[p] for p in zip(want, want[1:])]
    got = sum(r.weight * loss[r.prev, r.cur] for r in rows)
    assert math.isclose(got, _reference_mean(losses, len(want), context, batch), rel_tol=1e-9)


def test_stream_shorter_than_a_window_has_no_weights(make_encoded):
    stored, placed, _ = _laid_out(make_encoded([[5], [6]]), Joining())
    pairs = stream.pair_counts(stored, Joining(), placed)
    rows = stream.weighted_pairs(stored, Joining(), placed, pairs, 128, 32).collect()
    assert sum(r.n for r in rows) == 3 and all(r.weight is None for r in rows)


@pytest.mark.parametrize("context, stride, block", [(3, 1, 7), (4, 3, 5), (8, 16, 64), (5, 1, 4096)])
def test_windows_as_text_and_digest(make_encoded, context, stride, block):
    """Both spelled forms equal the joined arrays, also where blocks and documents end."""
    lists = [[i * 37 % 1301 for i in ids] for ids in _lists(9)]
    _, _, segs = _laid_out(make_encoded(lists, parts=4), Joining())
    plain = stream.next_token_windows(segs, context, stride, block).collect()
    want = {(r.split, r.start): [" ".join(map(str, side)) for side in (r.x, r.y)] for r in plain}
    assert want
    for sides, show in (("text", str), ("digest", lambda s: hashlib.md5(s.encode()).hexdigest())):
        rows = stream.next_token_windows(segs, context, stride, block, sides).collect()
        assert len(rows) == len(want)
        assert {(r.split, r.start): [r.x, r.y] for r in rows} == {
            k: [show(s) for s in v] for k, v in want.items()}
    with pytest.raises(ValueError):
        stream.next_token_windows(segs, context, sides="other")


def test_pairs_are_added_up_in_the_task(monkeypatch):
    monkeypatch.setattr(narrow, "PIECES", 8)
    lists = [[5, 6] * 4, [], None, [7], [6, 5, 6], [2**31 - 1, 0, 3], [5, 6] * 9]
    names = ["train", "val", "val", None, "train", None, "train"]
    batch = pa.record_batch([pa.array(names), pa.array(lists, pa.list_(pa.int32()))], ["split", "seg"])
    plain = Counter((n, *p) for n, ids in zip(names, lists) for p in zip(ids or [], (ids or [])[1:]))
    for held, parts in ((100, 2), (1, 4)):
        monkeypatch.setattr(stream, "HELD", held)
        out = list(stream._pairs_counted(["split"])(iter([batch, batch.slice(4)])))
        found = Counter()
        for row in (r for b in out for r in b.to_pylist()):
            found[row["split"], row["prev"], row["cur"]] += row["n"]
        assert found == plain + Counter((n, *p) for n, ids in zip(names[4:], lists[4:])
                                        for p in zip(ids, ids[1:]))
        assert len(out) >= parts  # one row a pair when all fit, more when they are passed on
        if held == 100:
            assert sum(b.num_rows for b in out) == len(plain)


def test_pairs_leave_the_task_counted(spark):
    rows = [("train", i, [5, 6] * 50) for i in range(3)]
    stored = stream.store_encoded(spark.createDataFrame(rows, "split string, doc_id bigint, ids array<int>"))
    found = stream.pair_counts(stored, stream.Joining())
    # 300 pairs would leave an explode as rows of their own.
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.prev, r.cur): r.n for r in found.collect()} == {
        (2, 5): 1, (5, 6): 150, (6, 5): 149, (6, 3): 1}
