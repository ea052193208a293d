"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from glyphloom.llm.common import arrow_stage, as_bytes, remainder, row_key

UNDECIDED = "und"
PIECE = 1 << 19       # bytes scored at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Fixed characters: A-Z fall to a-z, white space to space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def folded(text: bytes, order: int) -> np.ndarray:
    """The bytes that are coded, behind ``order`` spaces: the first context."""
    return np.frombuffer(b" " * order + text.translate(_FOLD), np.uint8)


def strings(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes, at most eight, that end at each place as one number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size - 1, -1, -1):
        out = out << np.uint64(8) | data[at - j]
    return out


class Numbers:
    """Exact look-up of the position of a key, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(int(2 * len(keys)).bit_length(), 4)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.probes = keys, 0
        left = np.arange(len(keys))
        place = self._home(keys)
        while len(left):
            self.probes += 1
            free = self.slots[place] < 0
            self.slots[place[free]] = left[free]  # one of those that meet stays
            lost = self.slots[place] != left
            left, place = left[lost], place[lost] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for unknown keys."""
        place = self._home(keys)
        found = self.slots[place]
        if not len(self.keys):
            return found
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = place[wrong]
        while len(wrong):
            at = at + 1 & (1 << self.bits) - 1
            found[wrong] = self.slots[at]
            again = (found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])
            wrong, at = wrong[again], at[again]
        return found


@dataclass(frozen=True)
class Model:
    """Frozen context trees of all languages, built on the driver.

    ``costs[k]`` are the bits, by language, of the known strings of ``k + 1`` bytes: the
    last byte after the context before it.  ``escapes[k]`` are the bits to leave the known
    contexts of ``k`` bytes.
    """

    languages: list[str]
    strings: list[Numbers]
    costs: list[np.ndarray]
    contexts: list[Numbers]
    escapes: list[np.ndarray]

    @property
    def order(self) -> int:
        return len(self.costs) - 1

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte of ``data`` behind the first ``order``, by language.

        A byte is coded after the longest context; where no language knows the two together,
        each leaves the context, and the next shorter one decides.
        """
        open_ = np.arange(self.order, len(data))
        out = np.zeros((len(open_), len(self.languages)))
        for k in range(self.order, -1, -1):
            packed = strings(data, open_, k + 1)
            found = self.strings[k](packed)
            known = found >= 0
            out[open_[known] - self.order] += self.costs[k][found[known]]
            open_, packed = open_[~known], packed[~known]
            context = self.contexts[k](packed >> np.uint64(8))
            left = context >= 0
            out[open_[left] - self.order] += self.escapes[k][context[left]]
        out[open_ - self.order] += 8.0
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of texts in bits, by language; short texts are coded together, long
        ones in pieces."""
        total = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0

        def add():
            ends = np.cumsum([len(data) for _, data in held])
            bits = self.bits(np.concatenate([data for _, data in held]))
            for (i, data), end in zip(held, (ends - self.order).tolist()):
                total[i] += bits[end - len(data) + self.order:end].sum(0)

        for i, text in enumerate(texts):
            data = folded(text, self.order)
            for at in range(self.order, len(data), PIECE):
                held.append((i, data[at - self.order:at + PIECE]))
                size += len(held[-1][1])
                if size >= PIECE:
                    add()
                    held, size = [], 0
        if held:
            add()
        return total


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of ``counts[k] = (sorted strings of k + 1 bytes, occurrences by language)``.

    In a context with ``t`` occurrences and ``d`` different next bytes a byte seen ``n``
    times has probability ``n / (t + d)`` and the escape ``d / (t + d)`` (method C, without
    exclusion).  A context that a language never saw is left for nothing.  Below the empty
    context all 256 bytes are alike.
    """
    known, costs, contexts, escapes = [], [], [], []
    for k, (keys, seen) in enumerate(counts):
        before, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        totals = np.zeros((len(before), len(languages)), np.int64)
        kinds = np.zeros_like(totals)
        np.add.at(totals, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(totals > 0, np.log2((totals + kinds) / kinds), 0.0)
            direct = np.log2((totals[of] + kinds[of]) / seen)
        # A string without its first byte occurs wherever the string does.
        shorter = costs[-1][np.searchsorted(counts[k - 1][0], keys & np.uint64((1 << 8 * k) - 1))] \
            if k else np.full(seen.shape, 8.0)
        known.append(Numbers(keys))
        costs.append(np.where(seen > 0, direct, leave[of] + shorter))
        contexts.append(Numbers(before))
        escapes.append(leave)
    return Model(languages, known, costs, contexts, escapes)


def _counts(sample: DataFrame, order: int) -> DataFrame:
    """``(lang, size, key, n)``: the strings of up to ``order + 1`` bytes that end at each
    byte of the texts."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                data = folded(text, order)
                for first in range(order, len(data), PIECE):
                    at = np.arange(first, min(first + PIECE, len(data)))
                    for size in range(1, order + 2):
                        keys, n = np.unique(strings(data, at, size), return_counts=True)
                        yield pa.record_batch(
                            [pa.array([lang] * len(keys), pa.string()),
                             pa.array(np.full(len(keys), size, np.int32)),
                             pa.array(keys.view(np.int64)), pa.array(n)],
                            ["lang", "size", "key", "n"])

    return arrow_stage(sample, run, "lang string, size int, key bigint, n bigint").groupBy(
        "lang", "size", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", order: int = 4, per_lang: int = 1000) -> Model:
    """Fit the trees on the ``per_lang`` different rows of smallest hash of each language.

    Rows without text or language, and those of the held-out fold, teach nothing.  The rows
    are found on their keys alone and their texts read whole; Spark counts the contexts and
    the driver keeps the counts, bounded by the sampled rows.
    """
    source = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        row_key(id_col, text_col).alias("key")).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    keys = source.select("lang", F.xxhash64("key").alias("h")).distinct()
    sizes = keys.groupBy("lang").count()
    # Few more than wanted by a bound on the hash, then exactly: no task sorts a language.
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("count"))
    near = keys.join(sizes, "lang").where(
        (F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64 <= share)
    chosen = near.withColumn("place", F.row_number().over(
        Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= per_lang).select("lang", "h")
    sample = source.withColumn("h", F.xxhash64("key")).join(
        F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    found = _counts(sample, order).toPandas()
    languages = sorted(found["lang"].unique())
    counts = []
    for size in range(1, order + 2):
        part = found[found["size"] == size]
        keys_, place = np.unique(part["key"].to_numpy().astype(np.uint64), return_inverse=True)
        seen = np.zeros((len(keys_), len(languages)), np.int64)
        seen[place, np.searchsorted(languages, part["lang"].to_numpy().astype(object))
             if len(part) else place] = part["n"].to_numpy()
        counts.append((keys_, seen))
    return build(languages, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)``: the language with the shortest code for each whole text,
    and its probability if all are equally likely before.

    Null texts and those without a letter are ``und`` with score 0, and so is every text if
    the model knows no language.  Among equal lengths the first name wins.  Repeated rows
    are reported alike, an empty table gives an empty result, and other columns are not read.
    Nothing is shuffled; texts are read whole, long ones in pieces.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                         F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False) & bool(model.languages)
            texts = [t if x else b"" for t, x in zip(as_bytes(batch.column(1)), letters.tolist())]
            names, scores = np.full(len(texts), UNDECIDED, object), np.zeros(len(texts))
            if letters.any():
                bits = model.lengths(texts)
                best = bits.argmin(1)
                more = bits - bits[np.arange(len(best)), best][:, None]
                names = np.where(letters, np.array(model.languages, object)[best], UNDECIDED)
                scores = np.where(letters, 1 / np.exp2(-np.minimum(more, 1000)).sum(1), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(names.tolist(), pa.string()),
                                   pa.array(scores)], ["id", "lang_pred", "score"])

    return arrow_stage(source, run, f"id {kind}, lang_pred string, score double")
