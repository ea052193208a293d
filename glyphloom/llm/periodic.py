"""Periodic runs of words by uniting suffix classes in descending order of common prefixes."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage, as_bytes

HELD = 500_000    # words that one task looks at together
WRITTEN = 8 << 20  # bytes of results in one batch
RESULT = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ODD = np.random.default_rng(29).integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by the crc32 ``h`` of its id in decimal (null: of nothing), with
    the words from ``a`` on replaced by repetitions of the first ``p`` of them."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def repeats(numbers: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """The documents, of those with dense numbers ``doc``, in which a string of ``width``
    words may occur twice; by hash, so now and then one more."""
    count = len(numbers) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    total = doc.astype(np.uint64)[:count] * _ODD[1]
    for j in range(width):
        total = (total ^ numbers[j:j + count].astype(np.uint64)) * _ODD[0]
        total ^= total >> np.uint64(29)
    whole = doc[:count] == doc[width - 1:]
    total, at = total[whole], doc[:count][whole]
    order = np.argsort(total)
    total, at = total[order], at[order]
    same = (total[1:] == total[:-1]) & (at[1:] == at[:-1])
    return np.unique(at[1:][same])


def suffix_order(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the common prefix of each with the next.

    Ranks by 1, 2, 4, ... words; the common prefixes are put together from the same ranks,
    longest first.
    """
    n = len(numbers)
    levels = [np.append(np.unique(numbers, return_inverse=True)[1].astype(np.int64), -1)]
    width = 1
    while width < n and int(levels[-1].max()) < n - 1:
        rank = levels[-1]
        later = np.full(n, -1, np.int64)
        later[:n - width] = rank[width:n]
        levels.append(np.append(np.unique(rank[:n] * (n + 1) + later + 1, return_inverse=True)[1], -1))
        width *= 2
    order = np.argsort(levels[-1][:n])
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = same * (1 << k)
        common += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    return order, common


def periodic_runs(numbers: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one text, by start, then period.

    A run of period ``q`` is a pair of suffixes ``q`` apart that have all of it but ``q``
    words in common.  Classes of suffixes are united in descending order of common prefixes;
    each keeps its places in order, and the smaller one is put into the larger.  Two places
    that become neighbours at a distance within that prefix are a seed: no place between
    them shares as much, so the distance is the smallest period, and the prefix ends the
    run.  The seed is the run's if it cannot be moved to the left.
    """
    n = len(numbers)
    if n < least:
        return []
    order, common = suffix_order(numbers)
    least_common = max(least * (times - 1) // times, 1)
    edges = np.flatnonzero(common >= least_common)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    places: dict[int, list[int]] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    found = []
    words, spot = numbers.tolist(), order.tolist()
    for edge, shared in zip(edges.tolist(), common[edges].tolist()):
        x, y = root(edge), root(edge + 1)
        big, small = places.pop(x, None) or [spot[x]], places.pop(y, None) or [spot[y]]
        if len(big) < len(small):
            big, small, x, y = small, big, y, x
        at, met = -1, []
        for i, s in enumerate(small):
            before = at
            at = bisect_left(big, s)
            if at and not (i and at == before + 1):
                met.append((big[at - 1], s))
            if at < len(big) and (i + 1 == len(small) or small[i + 1] > big[at]):
                met.append((s, big[at]))
            big.insert(at, s)
        parent[y] = x
        places[x] = big
        for p, r in met:
            period = r - p
            length = period + shared
            if length >= least and length >= times * period and (
                    not p or words[p - 1] != words[r - 1]):
                found.append((p, length, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, each run cut to its first period, joined by a space."""
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        kept = np.cumsum(step)[:-1] == 0
        words = [w for w, k in zip(words, kept.tolist()) if k]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6,
              times: int = 4, rewrite: Rewrite | None = None) -> DataFrame:
    """``(id, n_words, runs, collapsed)``: the periodic runs of words of each text, and the
    text with every run cut to its first period.

    Words are what stands between ASCII white space, case and all.  A run is a stretch with
    smallest period ``q`` of at least ``least`` and ``times * q`` words that no neighbouring
    word extends; ``runs`` is sorted by start, then period, as ``(start, length, period)``
    in words.  Runs may overlap; a word is dropped if it lies behind the first period of
    any.  ``rewrite(id, words)`` may replace the words of a text before.

    Nothing is shuffled.  A run holds a string of ``least * (times - 1) / times`` words
    twice, so texts without such a repetition are settled by one look at the hashes of many
    texts together; in the others suffixes are sorted, each text whole and by itself.  Null
    and empty texts have no words, no runs and an empty ``collapsed``.  Repeated rows are
    reported alike, an empty table gives an empty result, and other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"),
                         F.col(text_col).cast("string").alias("text"))
    width = max(-(-least * (times - 1) // times), 1)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def written(rows) -> pa.RecordBatch:
        ids, sizes, runs, texts = zip(*rows)
        named = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(named, kind),
             pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    def settle(held) -> Iterator[pa.RecordBatch]:
        sizes = [len(numbers) for _, _, numbers in held]
        doc = np.repeat(np.arange(len(held)), sizes)
        some = set(repeats(np.concatenate([n for _, _, n in held]), doc, width).tolist())
        rows, size = [], 0
        for i, (doc_id, words, numbers) in enumerate(held):
            runs = periodic_runs(numbers, least, times) if i in some else []
            text = collapse(words, runs)
            rows.append((doc_id, len(words), runs, text))
            size += len(text)
            if size >= WRITTEN:
                yield written(rows)
                rows, size = [], 0
        if rows:
            yield written(rows)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = text.split()
                if rewrite:
                    words = rewrite(doc_id, words)
                first: dict[bytes, int] = {}
                held.append((doc_id, words, np.array(
                    [first.setdefault(w, len(first)) for w in words], np.int64)))
                size += len(words) + 1
                if size >= HELD:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return arrow_stage(source, run, f"id bigint, n_words bigint, runs {RESULT}, collapsed string")
