"""Packing documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage
from glyphloom.session import checkpointed, parallelism

WINDOW = 2048
END_ID = 1
CACHE = 90_000  # chunks in each of the cache's two generations
# A space before a non-space character always starts a pre-token of the byte-level pattern.
_CUT = re.compile(r" (?=\S)")


class ChunkEncoder:
    """Token ids of whole texts as little-endian bytes, chunk by chunk.

    A text is cut where a pre-token must begin, so chunks are encoded each by itself and
    repeated ones come from a bounded cache.  Chunks of characters below U+0250 are encoded
    by the rank table (the same vocabulary, the quicker library), all others by the
    tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer_path)
        self.quick = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank)
                         for token, rank in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                           mergeable_ranks=ranks, special_tokens={})
        encode = self.encode_chunk

        class Cache(dict):
            older: dict = {}

            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE:
                    self.older = dict(self)
                    self.clear()
                found = self[chunk] = self.older.get(chunk) or encode(" " + chunk)
                return found

        self.cache = Cache()

    def encode_chunk(self, chunk: str) -> bytes:
        if self.quick and (chunk.isascii() or max(chunk) < "ɐ") and "<|" not in chunk:
            ids = self.quick.encode_ordinary(chunk)
        else:
            ids = self.full.encode(chunk, add_special_tokens=False).ids
        packed = array("I", ids)  # much quicker than numpy for a few ids
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = _CUT.split(text)
        return self.encode_chunk(first) + b"".join(map(self.cache.__getitem__, rest))


def _encoder(tokenizer_path: str, ranks_path: str | None) -> ChunkEncoder:
    """One encoder for all tasks of a Python worker, kept on the library's module."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_glyphloom_encoders", {})
    key = (tokenizer_path, ranks_path)
    if key not in held:
        held[key] = ChunkEncoder(*key)
    return held[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"),
            public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str,
           ranks_path: str | None, window: int = WINDOW) -> DataFrame:
    """Each document's ids and the end id, cut every ``window`` ids, as
    ``(id, start, length, ids_crc32, doc_tokens)``."""
    def run(batches):
        encoder = _encoder(tokenizer_path, ranks_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for number, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                rows.extend((number, at, min(window, total - at),
                             zlib.crc32(ids[4 * at:4 * (at + window)]), total)
                            for at in range(0, total, window))
            columns = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(columns[:, 0])),
                 *[pa.array(columns[:, i]) for i in range(1, 5)]],
                ["id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"),
                         F.col(text_col).cast("string").alias("text"))
    return arrow_stage(source, run, "id bigint, start bigint, length bigint, ids_crc32 bigint, "
                                    "doc_tokens bigint")


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths with the largest sum of at most ``room``.

    Subset sums are bits of one integer; a length with ``n`` copies is added in steps of
    1, 2, 4, ... copies.  The states are kept and walked back for the counts used.
    """
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums |= sums << (length * copies) & full
            left -= copies
            copies *= 2
        if sums >> room & 1:
            break
    target, used = sums.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + copies
            target -= length * copies
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: copies})``: the largest length left, with the fill of least slack,
    repeated as long as the counts last."""
    counts = {length: n for length, n in counts.items() if n}
    plan = []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        used = best_fill(window - longest, rest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[length] // copies for length, copies in used.items())
        plan.append((times, used))
        for length, copies in used.items():
            counts[length] -= times * copies
            if not counts[length]:
                del counts[length]
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length rows ``(first rank, copies, first window, offset)``: the piece of rank
    ``first rank + t * copies + c`` goes to window ``first window + t`` at
    ``offset + c * length``."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    window = 0
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            copies = used[length]
            found.setdefault(length, []).append(
                (taken.get(length, 0), copies, window, offset))
            taken[length] = taken.get(length, 0) + times * copies
            offset += length * copies
        window += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tokenizer_path: str | None = None, ranks_path: str | None = None,
         window: int = WINDOW) -> DataFrame:
    """All documents in sequences of at most ``window`` tokens, one row per piece:
    ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Texts are tokenized once and become a narrow table of pieces, range-partitioned by
    length and stored.  Only the histogram of lengths, at most ``window`` numbers whatever
    the corpus, reaches the driver, where the windows are planned.  A piece finds its place
    from its rank among the pieces of its length: a base from the counts of earlier
    partitions (partitions plus ``window`` numbers) and its place in its own partition, so
    neither a global sort nor a join is needed and a length that a third of all pieces
    share is spread over many tasks.

    Null and empty texts are one end id; repeated rows and null ids are packed like any
    other; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        tokenizer_path, ranks_path = default_paths()
    cut = pieces(docs, id_col, text_col, tokenizer_path, ranks_path, window)
    # Checkpointed before and after: the range bounds are sampled from stored rows, and
    # ranks refer to stored partitions.
    cut = checkpointed(checkpointed(cut).repartitionByRange(
        parallelism(spark), "length", "id", "start", "ids_crc32").withColumn(
            "part", F.spark_partition_id()))
    counts = cut.groupBy("part", "length").count().collect()
    total: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for row in sorted(counts):
        base[row.part, row.length] = total.get(row.length, 0)
        total[row.length] = total.get(row.length, 0) + row["count"]
    places = slots(plan_windows(total, window))

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            part = batch.column(5)[0].as_py() if batch.num_rows else 0
            lengths = batch.column(2).to_numpy()
            order = np.argsort(lengths, kind="stable")
            kinds, starts = np.unique(lengths[order], return_index=True)
            sequence = np.empty(len(lengths), np.int64)
            offset = np.empty(len(lengths), np.int64)
            for length, rows in zip(kinds.tolist(), np.split(order, starts[1:])):
                first = seen.setdefault(length, base[part, length])
                seen[length] = first + len(rows)
                rank = first + np.arange(len(rows))
                table = places[length]
                at = table[np.searchsorted(table[:, 0], rank, "right") - 1]
                turn, copy = np.divmod(rank - at[:, 0], at[:, 1])
                sequence[rows] = at[:, 2] + turn
                offset[rows] = at[:, 3] + copy * length
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return arrow_stage(cut, run, "id bigint, start bigint, length bigint, ids_crc32 bigint, "
                                 "doc_tokens bigint, sequence_id bigint, offset bigint")
