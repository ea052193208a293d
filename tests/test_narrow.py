"""Encoding and decoding in place, without a session: parts of a batch, memory of a task."""

import pyarrow as pa
from pyspark.sql import functions as F

from glyphloom.functions.text import whitespace_tokens
from glyphloom.operators import narrow


def _batch(lists, kind):
    return pa.record_batch([pa.array(["train"] * len(lists)), pa.array(range(len(lists)), pa.int64()),
                            pa.array(lists, pa.list_(kind))], ["split", "doc_id", "pieces"])


def _rows(batches):
    return [(r["doc_id"], r[name]) for b in batches for r in b.to_pylist()
            for name in ("ids" if "ids" in r else "text",)]


def test_a_task_works_on_bounded_parts(monkeypatch):
    monkeypatch.setattr(narrow, "PIECES", 10)
    monkeypatch.setattr(narrow, "MEMO", 5)
    lists = [["a", "bb"] * 2, [], None, ["ccc"] * 25, ["d"] * 6, ["a"] * 5, ["e" * (i + 1) for i in range(9)]]
    found = list(narrow._encoder(lambda p: [len(p)] * len(p))(iter([_batch(lists, pa.string())])))
    assert _rows(found) == [(i, [len(p) for p in ps for _ in p])
                            for i, ps in enumerate(lists) if ps is not None]
    assert len(found) == 5  # one batch of arrays as long as the input before
    ids = [[0, 1, 2], [], [2] * 30, [1] * 9, [2, 2]]
    parts = list(narrow._decoder(["x", "y", "z"], (0,))(iter([_batch(ids, pa.int32())])))
    assert _rows(parts) == [(i, " ".join("xyz"[k] for k in row if k)) for i, row in enumerate(ids)]
    assert len(parts) == 4


def test_a_piece_is_segmented_once_a_task():
    seen = []
    run = narrow._encoder(lambda p: seen.append(p) or [1])
    batches = [_batch([["a", "b"], ["a"]], pa.string()), _batch([["b", "c"]], pa.string())]
    assert [r for _, r in _rows(run(iter(batches)))] == [[1, 1], [1], [1, 1]]
    assert sorted(seen) == ["a", "b", "c"]


def test_pieces_met_again_are_remembered(monkeypatch):
    monkeypatch.setattr(narrow, "PIECES", 4)
    monkeypatch.setattr(narrow, "MEMO", 5)
    seen = []
    run = narrow._encoder(lambda p: seen.append(p) or [len(p)])
    lists = [["often", f"rare{i}", f"rarer{i}"] for i in range(30)]
    assert _rows(run(iter([_batch(lists, pa.string())]))) == [
        (i, [len(p) for p in ps]) for i, ps in enumerate(lists)]
    assert seen.count("often") == 1 and len(seen) == 61


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([("train", 1, "a bb"), ("train", 2, None), ("train", 3, "")],
                                 "split string, doc_id bigint, text string")
    found = narrow.encode_in_place(docs, whitespace_tokens(F.col("text")), lambda p: [len(p)])
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == [(1, [1, 2]), (3, [])]
    assert found._jdf.queryExecution().executedPlan().toString().count("split(text") == 1


def test_a_batch_is_copied_only_to_leave_out_rows():
    whole = _batch([["a", "b"], [], ["c"] * 3], pa.string())
    (part,) = narrow.parts_of_batches(iter([whole]))
    assert part.column(2).values.buffers()[2].address == whole.column(2).values.buffers()[2].address
    (part,) = narrow.parts_of_batches(iter([_batch([["a"], None, ["b"]], pa.string())]))
    assert part.column(1).to_pylist() == [0, 2]
