"""SimHash fingerprints and their near-duplicate groups by pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import (Forest, as_bytes, arrow_stage, blocked_groups, components,
                                  group_ids, whole_groups)
from glyphloom.session import checkpointed

BITS = 64
_LANES = np.uint64(0x0101010101010101)
GROUP = ["mask_no", "masked", "part_i", "part_j"]


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """A bit is set if it is set in over half of the shingle hashes; no words: zero."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = np.array([xxh64_intdigest(joined[a:b], 42)
                       for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    blocks = np.arange(0, len(hashes), 255)  # byte lanes hold sums up to 255
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, blocks)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    over = counts.ravel() * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3,
                 key_col: str | None = None) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long, one row per input row; with
    ``key_col`` its binary value stands between them as ``row_key``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  Null text is
    empty; equal texts, repeated and null ids all keep their rows.
    """
    names = ["id", "fp"] if key_col is None else ["id", "row_key", "fp"]

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.lower().split(), shingle) for t in as_bytes(batch.columns[-1])]
            yield pa.record_batch([*batch.columns[:-1], pa.array(
                np.array(prints, np.uint64).view(np.int64))], names)

    key = [] if key_col is None else [F.col(key_col).alias("row_key")]
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), *key,
                         F.col(text_col).cast("string").alias("text"))
    kinds = {"id": "bigint", "row_key": "binary", "fp": "bigint"}
    return arrow_stage(source, run, ", ".join(f"{n} {kinds[n]}" for n in names))


def _masks(distance: int, extra: int = 3) -> list[int]:
    """Masks over ``distance + extra`` blocks, ``extra`` of them kept: two fingerprints
    within ``distance`` bits agree under at least one mask."""
    count = distance + extra
    edges = [round(i * BITS / count) for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(blocks, extra)]


def pivots(count: int = 8, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, fixed by the seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64)


def pivot_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances to the references, one row per reference."""
    return np.stack([np.bitwise_count(prints ^ r) for r in refs]).astype(np.int8)


def close_pairs(prints: np.ndarray, groups: np.ndarray, distance: int, refs: np.ndarray,
                forest: Forest) -> None:
    """Unite the rows of a group that differ in at most ``distance`` bits.

    Rows are sorted by group.  Pairs are taken at row offsets 1, 2, ...; by the triangle
    inequality a pair whose table rows differ by more than ``distance`` in any coordinate
    is discarded, and only survivors are compared bit by bit.
    """
    coordinates = pivot_table(prints, refs)
    left = np.arange(len(prints))
    offset = 1
    while True:
        left = left[left + offset < len(prints)]
        left = left[groups[left] == groups[left + offset]]
        if not len(left):
            return
        rows = left
        for column in coordinates:
            rows = rows[np.abs(column[rows] - column[rows + offset]) <= distance]
        rows = rows[np.bitwise_count(prints[rows] ^ prints[rows + offset]) <= distance]
        forest.add(rows, rows + offset)
        offset += 1


def near_links(prints: DataFrame, distance: int = 3, block: int = 4096,
               pivot_count: int = 8) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that join every close pair.

    Each distinct fingerprint goes to one bucket per mask; any two within ``distance`` meet
    in at least one, whatever the data.  In a bucket a pivot table discards pairs and the
    survivors are verified.  A spanning forest of each bucket is returned, not its pairs;
    buckets above ``block`` rows are dealt out as pairs of blocks over several tasks.
    """
    distinct = prints.where("fp IS NOT NULL").select("fp").distinct()
    keyed = distinct.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))
          for m in _masks(distance)])).alias("mask_no", "masked"))
    dealt = blocked_groups(keyed, ["mask_no", "masked"], "fp", block)
    refs = pivots(pivot_count)

    def run(batches):
        for joined in whole_groups(batches, GROUP):
            fps = joined["fp"].to_numpy()
            forest = Forest(len(fps))
            close_pairs(fps.view(np.uint64), group_ids(joined, GROUP), distance, refs, forest)
            ends = np.array(forest.links, np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(fps[ends[:, 0]]), pa.array(fps[ends[:, 1]])],
                                  ["a", "b"])

    return arrow_stage(dealt.select(*GROUP, "fp"), run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, distance: int = 3, key_col: str | None = None) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id reachable over links
    between fingerprints that differ in at most ``distance`` bits.

    Equal fingerprints are one node, so a group of copies is one row in the search.  Null
    and empty texts have fingerprint zero and are linked like any other.  A null id keeps
    its row and never becomes a component id; a component of null ids has a null one.
    Repeated rows are kept; an empty table gives an empty result.

    With ``key_col``, a binary key without nulls, the columns ``row_key`` and
    ``component_key`` are added: the key of the component's row with the smallest id (rows
    without id last), of several such rows the smallest key.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle, key_col))
    found = components(near_links(prints, distance)).withColumnRenamed("node", "fp")
    marked = prints.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    if key_col is None:
        first = marked.groupBy("label").agg(F.min("id").alias("component_id"))
        return marked.join(first, "label").select("id", "fp", "component_id")
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key"))
    first = marked.groupBy("label").agg(least.alias("first")).select(
        "label", F.col("first.id").alias("component_id"),
        F.col("first.row_key").alias("component_key"))
    return marked.join(first, "label").select("id", "fp", "component_id", "row_key",
                                              "component_key")
