"""Encoding and decoding in place: one Arrow stage per task, no row moves.

Only the model travels, which ``vocab_size`` bounds.  A batch is worked off in parts of a
fixed number of pieces or ids, so that a task needs no more memory on a larger corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


PIECES = 200_000  # pieces or ids that a task works on at once
MEMO = 150_000    # distinct pieces whose ids a task remembers, and as many of before


def parts_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut between rows so that the lists of its last column hold at most
    ``most`` items a part; a longer list is a part of its own."""
    ends = _offsets(batch.columns[-1])[1:]
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + most, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def parts_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all batches, rows without a list left out."""
    for batch in batches:
        if batch.columns[-1].null_count:  # only then: it copies the batch
            batch = batch.filter(batch.columns[-1].is_valid())
        yield from parts_of(batch, PIECES)
        del batch  # not held while the next one is read


def _offsets(lists: pa.ListArray) -> np.ndarray:
    at = lists.offsets.to_numpy()
    return (at - at[0]).astype(np.int64)


def tokens_by_id(vocab: DataFrame) -> list[str]:
    """The tokens of a vocabulary ``(id, token)`` whose ids are 0, 1, 2, ..."""
    rows = sorted((r.id, r.token) for r in vocab.select("id", "token").collect())
    if [i for i, _ in rows] != list(range(len(rows))):
        raise ValueError("vocabulary ids are not 0, 1, 2, ...")
    return [token for _, token in rows]


def _encoder(segment: Callable[[str], list[int]]):
    """The task of :func:`encode_in_place`."""
    def run(batches):
        memo: dict[str, list[int]] = {}
        older: dict[str, list[int]] = {}
        for part in parts_of_batches(batches):
            lists = part.column(2)
            flat = lists.flatten().dictionary_encode()
            if len(memo) > MEMO:  # pieces not met again are forgotten, and segmented anew
                memo, older = {}, memo
            found = []
            for piece in flat.dictionary.to_pylist():
                ids = memo.get(piece)
                if ids is None:
                    ids = older.get(piece)
                    ids = memo[piece] = segment(piece) if ids is None else ids
                found.append(ids)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            first = np.cumsum(sizes) - sizes
            code = flat.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes[code])])
            place = np.arange(ends[-1]) + np.repeat(first[code] - ends[:-1], sizes[code])
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(
                    pa.array(ends[_offsets(lists)].astype(np.int32)), pa.array(ids[place]))],
                ["split", "doc_id", "ids"])

    return run


def encode_in_place(docs: DataFrame, pieces: Column,
                    segment: Callable[[str], list[int]]) -> DataFrame:
    """``(split, doc_id, ids)``: the ids of each piece, in order.

    A task segments a distinct piece once, as long as it remembers it.  Documents without
    pieces keep an empty array; null texts are left out.
    """
    # Null texts go in the task: a filter on the pieces would cut every text twice.
    named = docs.select("split", "doc_id", pieces.alias("pieces"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_encoder(segment), f"split string, doc_id {doc_id}, ids array<int>")


def _decoder(tokens: list[str], skip: tuple[int, ...]):
    """The task of :func:`decode_in_place`."""
    def run(batches):
        names = pa.array(tokens, pa.string())
        shown = np.ones(len(tokens), bool)
        shown[[i for i in skip if i < len(tokens)]] = False
        for part in parts_of_batches(batches):
            lists = part.column(2)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            wrong = (ids < 0) | (ids >= len(tokens))
            if wrong.any():
                raise ValueError(f"id out of range: {ids[wrong][0]}")
            kept = shown[ids]
            ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends[_offsets(lists)]),
                                             names.take(pa.array(ids[kept])))
            yield pa.record_batch([part.column(0), part.column(1), pc.binary_join(words, " ")],
                                  ["split", "doc_id", "text"])

    return run


def decode_in_place(encoded: DataFrame, tokens: list[str], skip: tuple[int, ...]) -> DataFrame:
    """``(split, doc_id, text)``: tokens by id joined by a space, ``skip`` left out.

    An id without a token is an error.
    """
    doc_id = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("split", "doc_id", "ids").where("ids IS NOT NULL").mapInArrow(
        _decoder(tokens, skip), f"split string, doc_id {doc_id}, text string")
