"""Byte-pair encoding: vocabulary training as an iterative Spark job, and encoding."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.functions.segment import merge_in_order, merge_unit
from glyphloom.functions.text import PRETOKEN_RAW, PRETOKEN_SPECIALS, SPECIALS, UNK, pretokens
from glyphloom.operators.stream import Joining
from glyphloom.operators.narrow import encode_in_place
from glyphloom.operators.subword import alphabet, special_ids, subword_decode
from glyphloom.session import checkpointed

# What one round brings to the driver at most: pairs, and symbols of regions.
LIVE_PAIRS = 50_000
REGION_SYMBOLS = 500_000
SPELLED = "n bigint, ids array<int>"


@dataclass(frozen=True)
class BpeModel:
    """``vocab(id, token)`` and ``merges(rank, left, right)``, bounded by ``vocab_size``.

    Mode ``pretokenized`` knows the special tokens and drops white space; mode ``raw``
    encodes special tokens as text and gives every white space character one unk id.
    """

    vocab: DataFrame
    merges: DataFrame
    vocab_size: int
    mode: str = "pretokenized"

    def __post_init__(self):
        if self.mode not in ("pretokenized", "raw"):
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def pattern(self) -> str:
        return PRETOKEN_RAW if self.mode == "raw" else PRETOKEN_SPECIALS

    def segmenter(self):
        """A function unit -> ids; holds the merges, at most ``vocab_size`` of them."""
        ids = {r.token: r.id for r in self.vocab.collect()}
        ranks = {(r.left, r.right): r["rank"] for r in self.merges.collect()}
        literal = self.mode == "raw"

        def segment(unit: str) -> list[int]:
            known = None if literal else special_ids(unit)
            return known or [ids.get(s, UNK) for s in merge_unit(unit, ranks)]

        return segment

    def joining(self) -> Joining:
        if self.mode == "pretokenized":
            return Joining()
        # The begin and end markers are plain text here: "<bos> " and " <eos>".
        segment = self.segmenter()
        marks = {w: [i for unit in ("<", w, ">") for i in segment(unit)] for w in ("bos", "eos")}
        return Joining((*marks["bos"], UNK), (UNK,), (UNK, *marks["eos"]))


def bpe_encode(docs: DataFrame, model: BpeModel) -> DataFrame:
    """``(split, doc_id, ids)`` without begin and end markers."""
    return encode_in_place(docs, pretokens(F.col("text"), model.pattern), model.segmenter())


def bpe_decode(encoded: DataFrame, model: BpeModel, skip_specials: bool = True) -> DataFrame:
    return subword_decode(encoded, model.vocab, registered=model.mode == "pretokenized",
                          skip_specials=skip_specials)


def bpe_train(units: DataFrame, vocab_size: int = 5000,
              region_symbols: int = REGION_SYMBOLS) -> BpeModel:
    """Learn merges from ``(unit, n)`` until the vocabulary is full or no pair is left.

    A round settles every merge down to some count ``floor``.  A pair that is rarer than
    that cannot reach it: merging takes occurrences from the pairs beside it, and the pairs
    it makes are no more frequent than those were.  So only stretches of *live* pairs, at
    least ``floor`` each, matter: the *regions*.  Spark counts the pairs, cuts the units into
    regions and adds up equal ones; the driver replays the merges on those (see
    ``replay``), at most ``region_symbols`` symbols; Spark applies them to all units.  The
    floor is the lowest whose regions fit, so a round settles hundreds of merges on small
    corpora and always at least one.

    ``units`` is read twice, so it should be stored; each round has as many tasks as it has parts.
    """
    spark = units.sparkSession
    letters = [r.token for r in alphabet(units).orderBy("id").collect()]
    ids = {t: i for i, t in enumerate([*SPECIALS, *letters])}
    current = _spelled(units, ids)
    merges: list[tuple[str, str]] = []
    wanted = LIVE_PAIRS
    while len(ids) < vocab_size:
        ranked = [(r.n, r.left, r.right) for r in _pair_counts(current).orderBy(
            F.desc("n"), "left", "right").limit(LIVE_PAIRS).collect()]
        if not ranked:
            break
        regions, floor, wanted = _regions(current, ranked, wanted, region_symbols)
        names = list(ids)
        steps = replay(regions, floor, ids, vocab_size) if floor else [ranked[0][1:]]
        for left, right in steps:
            merges.append((names[left], names[right]))
            made = names[left] + names[right]
            if made not in ids:
                ids[made] = len(ids)
                names.append(made)
        if floor == 1:
            break
        if len(ids) < vocab_size:
            current = _applied(current, steps, [ids[names[a] + names[b]] for a, b in steps])
    vocab = spark.createDataFrame(
        pd.DataFrame({"id": list(ids.values()), "token": list(ids)}), "id int, token string")
    merged_rows = pd.DataFrame({"rank": range(len(merges)),
                                "left": [m[0] for m in merges],
                                "right": [m[1] for m in merges]})
    return BpeModel(vocab, spark.createDataFrame(
        merged_rows, "rank int, left string, right string"), len(ids))


def _spelled(units: DataFrame, ids: dict[str, int]) -> DataFrame:
    """``(n, ids)``: the letters of each unit of two or more."""
    def run(batches):
        for batch in batches:
            yield pa.record_batch(
                [batch.column(0), pa.array([[ids[c] for c in u] for u in batch.column(1).to_pylist()],
                                           pa.list_(pa.int32()))], ["n", "ids"])

    return checkpointed(units.where(F.char_length("unit") > 1).select("n", "unit")
                        .mapInArrow(run, SPELLED))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a batch of units, the offsets, and by place the pair that begins there and
    whether one does."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    symbols = lists.flatten().to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    pairs = np.append(symbols[:-1] << 32 | symbols[1:], 0)[:len(symbols)]
    inside = np.ones(len(symbols), bool)
    inside[offsets[1:] - 1] = False
    return symbols, offsets, pairs, inside


def _pair_counts(current: DataFrame) -> DataFrame:
    """``(left, right, n)`` over all units, added up in each batch before the shuffle."""
    def run(batches):
        for batch in batches:
            _, offsets, pairs, inside = _flat(batch)
            weights = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))[inside]
            pairs = pairs[inside]
            if not len(pairs):
                continue
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            keys = pairs[heads]
            yield pa.record_batch(
                [pa.array((keys >> 32).astype(np.int32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(np.add.reduceat(weights[order], heads))], ["left", "right", "n"])

    return current.mapInArrow(run, "left int, right int, n bigint").groupBy("left", "right").agg(
        F.sum("n").alias("n"))


def _regions(current: DataFrame, ranked: list[tuple[int, int, int]], wanted: int,
             symbols: int) -> tuple[list[tuple[list[int], int]], int, int]:
    """Regions with their counts, the floor they hold for, and how many live pairs to try
    in the next round.  Floor 0 and no regions if not even the first pairs' fit."""
    complete = len(ranked) < LIVE_PAIRS
    take = min(wanted, len(ranked))
    while True:
        if take == len(ranked) and complete:
            floor = 1
        else:  # pairs as frequent as the last one may be missing
            floor = ranked[take - 1][0] + 1
        live = [(a, b) for n, a, b in ranked if n >= floor]
        if not live:
            return [], 0, max(take, 2)
        cut = _cut_regions(current, np.sort(np.array([a << 32 | b for a, b in live], np.int64)))
        total = cut.agg(F.sum(F.size("ids"))).first()[0]
        if total <= symbols:
            rows = cut.toArrow()  # in one job, whatever the number of partitions
            cut.unpersist()
            found = list(zip(rows["ids"].to_pylist(), rows["n"].to_pylist()))
            return found, floor, min(take * max(2, min(16, symbols // (total or 1))), LIVE_PAIRS)
        cut.unpersist()
        if take == 1:
            return [], 0, 2
        take = max(1, min(take // 2, int(take * symbols / total)))


def _cut_regions(current: DataFrame, live: np.ndarray) -> DataFrame:
    """``(ids, n)``: the distinct longest stretches of live pairs."""
    def run(batches):
        for batch in batches:
            symbols, offsets, pairs, inside = _flat(batch)
            on = inside & np.isin(pairs, live)
            first = np.flatnonzero(on & ~np.append(False, on[:-1]))
            last = np.flatnonzero(on & ~np.append(on[1:], False))
            unit = np.searchsorted(offsets, first, side="right") - 1
            total: defaultdict = defaultdict(int)
            flat, weights = symbols.astype(np.int32), batch.column(0).to_numpy()
            for a, b, n in zip(first.tolist(), (last + 2).tolist(), weights[unit].tolist()):
                total[flat[a:b].tobytes()] += n
            yield pa.record_batch(
                [pa.array([np.frombuffer(k, np.int32) for k in total], pa.list_(pa.int32())),
                 pa.array(list(total.values()), pa.int64())], ["ids", "n"])

    # A stored table is not coalesced by itself: as many parts as the units have.
    dealt = current.mapInArrow(run, "ids array<int>, n bigint").repartition(
        current.rdd.getNumPartitions(), "ids")
    return dealt.groupBy("ids").agg(F.sum("n").alias("n")).persist()


def replay(regions: list[tuple[list[int], int]], floor: int, ids: dict[str, int],
           vocab_size: int) -> list[tuple[int, int]]:
    """The merges greedy training takes as long as one occurs ``floor`` times.

    ``ids`` numbers the known tokens, new ones get the numbers that follow.  Postings lead
    from a pair to the regions that may hold it, so a merge reads only those and adds the
    differences to the counts; the heap is corrected when a stale entry comes up.  Order:
    count, then the numbers of the two symbols.  With a floor above 1, a merge that makes a
    known token ends the round: that token may stand beside symbols outside the regions.
    """
    names, known = list(ids), dict(ids)
    words = [r for r, _ in regions]
    weights = [n for _, n in regions]
    counts: defaultdict = defaultdict(int)
    holders: defaultdict = defaultdict(set)
    for i, (word, n) in enumerate(regions):
        for pair in zip(word, word[1:]):
            counts[pair] += n
            holders[pair].add(i)
    heap = [(-n, *pair) for pair, n in counts.items()]
    heapq.heapify(heap)
    steps: list[tuple[int, int]] = []
    while heap and len(known) < vocab_size:
        n, left, right = heapq.heappop(heap)
        pair = left, right
        if counts.get(pair, 0) != -n:
            if counts.get(pair, 0) > 0:
                heapq.heappush(heap, (-counts[pair], left, right))
            continue
        if -n < floor:
            break
        steps.append(pair)
        token = names[left] + names[right]
        repeated = token in known
        if not repeated:
            known[token] = len(names)
            names.append(token)
        new = known[token]
        changed = set()
        for i in holders.pop(pair):
            old, merged, at = words[i], [], 0
            while at < len(old):
                if old[at] == left and at + 1 < len(old) and old[at + 1] == right:
                    merged.append(new)
                    at += 2
                else:
                    merged.append(old[at])
                    at += 1
            if len(merged) == len(old):
                continue
            for p in zip(old, old[1:]):
                counts[p] -= weights[i]
            for p in zip(merged, merged[1:]):
                counts[p] += weights[i]
                if new in p:
                    holders[p].add(i)
                    changed.add(p)
            words[i] = merged
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], *p))
        if repeated and floor > 1:
            break
    return steps


def _applied(current: DataFrame, steps: list[tuple[int, int]], made: list[int]) -> DataFrame:
    """Units after the merges; those of one symbol have no pair left and go."""
    rules = {pair: (rank, new) for rank, (pair, new) in enumerate(zip(steps, made))}
    starts = np.sort(np.array([a << 32 | b for a, b in rules], np.int64))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, pairs, inside = _flat(batch)
            hit = np.append(0, np.cumsum(inside & np.isin(pairs, starts)))
            touched = hit[offsets[1:]] > hit[offsets[:-1]]
            kept = [merge_in_order(u, rules) if t else u
                    for u, t in zip(batch.column(1).to_pylist(), touched.tolist())]
            long = pa.array([len(u) > 1 for u in kept])
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.list_(pa.int32()))],
                                  ["n", "ids"]).filter(long)

    return checkpointed(current.mapInArrow(run, SPELLED))
