"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage, as_bytes

# Words are runs of ASCII letters and digits and of all bytes of other characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32
              for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class SizeClass:
    """Items of ``low`` to ``2 * low - 1`` words and the hash tables of their windows."""

    low: int
    items: list[int]
    tables: list["Table"] = field(default_factory=list)


@dataclass
class Table:
    """One repetition: a walk, the sampled steps, and the items' keys."""

    seed: int
    shift: int  # words from the start of the window to the start of the walk
    steps: list[int]
    allowed: list[np.ndarray]  # per sampled step, which word ids some item has there
    keys: np.ndarray
    owners: np.ndarray


@dataclass
class Index:
    vocab: dict[bytes, int]
    words: list[np.ndarray]
    item_ids: list
    classes: list[SizeClass]
    similarity: float
    bags: list[frozenset] = field(default_factory=list)

    def allowance(self, item: int) -> int:
        return int(len(self.words[item]) * (1 - self.similarity) + 1e-9)


def walk_bits(ids: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits per word; bit ``t`` says whether the walk moves on at step ``t``."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(seed + 1) * _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def embed(ids: np.ndarray, starts: np.ndarray, seed: int, steps: list[int],
          allowed: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The sampled symbols of the CGK embedding of the words from each start.

    At step ``t`` the embedding holds the word under the walk, which then moves on or stays
    by a random bit of that word: after an edit two walks meet again, so a few edits change
    few symbols.  ``ids`` must end with as many paddings as the last step.  Starts whose
    sampled word no item has at that step are dropped; the rest are returned with a hash of
    their samples.
    """
    def moves(seed: int) -> np.ndarray:
        if allowed is None:
            return walk_bits(ids, seed)
        return walk_bits(np.arange(len(allowed[0])), seed)[ids]

    bits = moves(seed)
    at, origin = starts.copy(), starts
    key = np.zeros(len(at), np.uint64)
    step = 0
    with np.errstate(over="ignore"):
        for number, sampled in enumerate(steps):
            while step < sampled:
                if step % 64 == 0 and step:
                    bits = moves(seed + 1_000_003 * (step // 64))
                at += (bits[at] >> np.uint64(step % 64)).astype(np.int64) & 1
                step += 1
            symbol = ids[at]
            if allowed is not None:
                kept = allowed[number][symbol]
                at, origin, key, symbol = at[kept], origin[kept], key[kept], symbol[kept]
            key = (key ^ symbol.astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(31)
    return origin, key


def _table(index: Index, group: SizeClass, seed: int, samples: int) -> Table:
    draw = np.random.default_rng(seed)
    steps = sorted(draw.choice(group.low, min(samples, group.low), replace=False).tolist())
    shift = group.low // 2 if seed % 2 else 0
    padding = np.zeros(group.low + 1, np.int32)
    flat = np.concatenate([np.concatenate([index.words[i], padding]) for i in group.items])
    sizes = [len(index.words[i]) + len(padding) for i in group.items]
    starts = np.cumsum([0, *sizes[:-1]]) + shift
    _, keys = embed(flat, starts, seed, steps, None)
    allowed = []
    for step in steps:  # the symbols at each sampled step, once more by themselves
        seen = np.zeros(len(index.vocab) + 1, bool)
        at, bits = starts.copy(), walk_bits(flat, seed)
        for t in range(step):
            if t % 64 == 0 and t:
                bits = walk_bits(flat, seed + 1_000_003 * (t // 64))
            at += (bits[at] >> np.uint64(t % 64)).astype(np.int64) & 1
        seen[flat[at]] = True
        seen[0] = False
        allowed.append(seen)
    order = np.argsort(keys, kind="stable")
    return Table(seed, shift, steps, allowed, keys[order], np.array(group.items)[order])


def _candidates(table: Table, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and window starts whose samples agree in one table."""
    origin, key = embed(ids, starts, table.seed, table.steps, table.allowed)
    low = np.searchsorted(table.keys, key, "left")
    count = np.searchsorted(table.keys, key, "right") - low
    rows = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    return table.owners[low[rows] + nth], origin[rows] - table.shift


def _edited(words: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        place, kind = int(draw.integers(0, len(out))), int(draw.integers(0, 3))
        out[place:place + (kind < 2)] = [] if kind == 0 and len(out) > 1 else [0]
    return np.array(out, np.int32)


def build_index(items: list[tuple], similarity: float = 0.8, recall: float = 0.97,
                samples: int = 5, max_tables: int = 96, trials: int = 400) -> Index:
    """Tables for ``(item_id, text)`` rows; items without words are left out.

    Tables are added to a size class until the measured recall reaches ``recall``: copies of
    its items with the most edits that the similarity allows, at random places, are sought.
    """
    vocab: dict[bytes, int] = {}
    words, item_ids = [], []
    for item_id, text in items:
        found = words_of((text or "").encode())
        if found:
            words.append(np.array([vocab.setdefault(w, len(vocab) + 1) for w in found], np.int32))
            item_ids.append(item_id)
    index = Index(vocab, words, item_ids, [], similarity,
                  [frozenset(w.tolist()) for w in words])
    by_low: dict[int, list[int]] = {}
    for number, item in enumerate(words):
        by_low.setdefault(1 << (len(item).bit_length() - 1), []).append(number)
    for low, members in sorted(by_low.items()):
        group = SizeClass(low, members)
        index.classes.append(group)
        draw = np.random.default_rng(low)
        chosen = draw.choice(members, trials)
        pad = np.zeros(3 * low + 2, np.int32)
        parts = [np.concatenate([pad, _edited(words[i], index.allowance(i), draw)]) for i in chosen]
        place = np.cumsum([len(p) for p in parts])
        ids = np.concatenate([*parts, pad])
        starts = np.arange(len(ids) - len(pad))
        trial = np.searchsorted(place, starts, "right")
        caught = np.zeros(trials, bool)
        while caught.mean() < recall and len(group.tables) < max_tables:
            table = _table(index, group, len(group.tables) + 1000 * low, samples)
            group.tables.append(table)
            owners, origin = _candidates(table, ids, starts)
            of = trial[np.clip(origin + table.shift, 0, len(trial) - 1)]
            caught[of[chosen[of] == owners]] = True
    return index


def edit_search(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where it ends.

    Bit-parallel over the pattern (Myers), so one step per word of the text.
    """
    size = len(pattern)
    last, mask = 1 << (size - 1), (1 << size) - 1
    at: dict[int, int] = {}
    for place, word in enumerate(pattern):
        at[word] = at.get(word, 0) | 1 << place
    plus, minus, now = mask, 0, size
    best, end = size, 0
    for place, word in enumerate(text):
        same = at.get(word, 0)
        vertical = same | minus
        level = (((same & plus) + plus) ^ plus) | same
        up = minus | ~(level | plus) & mask
        down = plus & level
        now += bool(up & last) - bool(down & last)
        up, down = up << 1 & mask, down << 1 & mask
        plus = down | ~(vertical | up) & mask
        minus = up & vertical
        if now < best:
            best, end = now, place + 1
    return best, end


def find_items(index: Index, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """``(text number, item number, edits, first word, end word)``, the best per text and item."""
    longest = max((len(w) for w in index.words), default=0)
    pad = longest + 2
    split = [words_of(t) for t in texts]
    get = index.vocab.get
    ids = np.zeros(sum(map(len, split)) + pad * (len(split) + 1), np.int32)
    begin, end, at = [], [], pad
    for found in split:
        ids[at:at + len(found)] = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        begin.append(at)
        end.append(at + len(found))
        at += len(found) + pad
    starts = np.flatnonzero(ids)
    first = np.array(begin)
    bags = index.bags
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for group in index.classes:
        seen = [_candidates(table, ids, starts) for table in group.tables]
        if not seen:
            continue
        owners = np.concatenate([o for o, _ in seen])
        origin = np.concatenate([np.maximum(s, first[np.searchsorted(
            first, s + table.shift, "right") - 1]) for table, (_, s) in zip(group.tables, seen)])
        order = np.lexsort((origin, owners))
        owners, origin = owners[order], origin[order]
        slack = group.low // 2 + 2
        fresh = np.ones(len(owners), bool)
        fresh[1:] = (owners[1:] != owners[:-1]) | (origin[1:] - origin[:-1] > slack)
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(owners)) - 1
        for item, low, high in zip(owners[heads].tolist(), origin[heads].tolist(),
                                   origin[tails].tolist() if len(heads) else []):
            pattern, allowed = index.words[item].tolist(), index.allowance(item)
            doc = int(np.searchsorted(first, low, "right")) - 1
            left = max(low - allowed - slack, begin[doc])
            right = min(high + len(pattern) + allowed + slack, end[doc])
            region = ids[left:right].tolist()
            # Every word that is not edited stands in the region.
            if sum(map(bags[item].__contains__, region)) < len(pattern) - allowed:
                continue
            edits, stop = edit_search(pattern, region)
            if edits > allowed:
                continue
            _, back = edit_search(pattern[::-1], region[:stop][::-1])
            span = (edits, left + stop - back - begin[doc], left + stop - begin[doc])
            if span < best.get((doc, item), (allowed + 1, 0, 0)):
                best[doc, item] = span
    return [(doc, item, *span) for (doc, item), span in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """The benchmark in lists of at most ``size`` items, one in memory at a time."""
    held = []
    for row in benchmark.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.97,
                  block_items: int = 20_000,
                  build: Callable[..., Index] = build_index) -> DataFrame:
    """One row for each document and benchmark item that stands in it:
    ``(id, item_id, edits, similarity, first_word, end_word)``.

    An item stands in a document if some stretch of the document's words is within edit
    distance ``(1 - similarity) * words of the item``.  Item-sized windows at every word of
    the whole text are embedded; windows whose sampled symbols agree with an item's in any
    table are candidates, and every candidate is verified exactly.  The index of at most
    ``block_items`` items travels with the task; a larger benchmark takes one scan of the
    documents per block.  Documents are never shuffled, and a hot item or source is as
    cheap as any other.

    Null or empty texts and items match nothing; equal items are found each by its id;
    repeated documents give repeated rows; empty tables give an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = (docs.schema[id_col].dataType.simpleString(),
             benchmark.schema[item_id_col].dataType.simpleString())
    schema = (f"id {kinds[0]}, item_id {kinds[1]}, edits bigint, similarity double, "
              "first_word bigint, end_word bigint")
    result = None
    for items in _blocks(benchmark, item_id_col, item_text_col, block_items):
        index = build(items, similarity, recall)

        def run(batches, index=index):
            if not index.words:
                return
            ids_of = pa.array(index.item_ids)
            for batch in batches:
                found = find_items(index, as_bytes(batch.column(1)))
                rows = np.array(found, np.int64).reshape(-1, 5)
                sizes = np.array([len(w) for w in index.words])[rows[:, 1]]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows[:, 0])), ids_of.take(pa.array(rows[:, 1])),
                     pa.array(rows[:, 2]), pa.array(1 - rows[:, 2] / sizes),
                     pa.array(rows[:, 3]), pa.array(rows[:, 4])],
                    ["id", "item_id", "edits", "similarity", "first_word", "end_word"])

        part = arrow_stage(source, run, schema)
        result = part if result is None else result.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result
