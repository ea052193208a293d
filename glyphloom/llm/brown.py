"""Brown class-based bigrams: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage, as_bytes, group_ids, remainder, whole_groups
from glyphloom.llm.wordclasses import PAIRS, PLACES, Numbers, deal, merged, settle, sweep, xlogx
from glyphloom.session import written

FOLD = 1          # remainder of the documents that are held out
ADD = 0.5
FLUSH = 400_000   # distinct words that one task holds before it writes them


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over the column ``text``, summed in each task before the shuffle."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.record_batch([pa.array(list(held), pa.binary()),
                                    pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.update(words_of(text))
                if len(held) >= FLUSH:
                    yield flush()
                    held.clear()
        yield flush()

    return arrow_stage(docs.select("text"), run, "word binary, n bigint").groupBy("word").agg(
        F.sum("n").alias("n"))


@dataclass(frozen=True)
class Symbols:
    """What is clustered: words, ``count`` in all, the endings of all other words, one for any
    other word, and the end of a text, in this order.  ``words`` has the frequent ones; words
    beyond them are found in the table of counts."""

    words: dict[bytes, int]
    endings: dict[bytes, int]
    count: int

    @property
    def other(self) -> int:
        return self.count + len(self.endings)

    @property
    def end(self) -> int:
        return self.other + 1

    def ending(self, word: bytes) -> int:
        return self.endings.get(word[-2:], self.other)

    def of(self, word: bytes) -> int:
        found = self.words.get(word)
        return self.ending(word) if found is None else found


def symbol_bigrams(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """``(pair, n)``, ``pair`` being ``before * count + after`` over all texts; a text is
    preceded by the end symbol."""
    size = symbols.end + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        cache: dict[bytes, int] = {}
        for batch in batches:
            stream = []
            for text in as_bytes(batch.column(0)):
                for word in (words := words_of(text)):
                    if word not in cache:
                        if len(cache) >= FLUSH:
                            cache.clear()
                        cache[word] = symbols.of(word)
                    stream.append(cache[word])
                stream.append(symbols.end)
                del words
            line = np.array([symbols.end, *stream], np.int64)
            pairs, n = np.unique(line[:-1] * size + line[1:], return_counts=True)
            total[pairs] += n
        pairs = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pairs), pa.array(total[pairs])], ["pair", "n"])

    return arrow_stage(docs.select("text"), run, "pair bigint, n bigint").groupBy("pair").agg(
        F.sum("n").alias("n"))


_f = xlogx


def exchange(pairs: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """A class for each symbol by the exchange algorithm.

    Each symbol but the last, the end, which keeps a class of its own, moves to the class
    that raises the class-bigram likelihood most, until a sweep moves none, or for ``sweeps``
    sweeps.  Symbols start by falling frequency in classes 0, 1, ... in turn.
    """
    size = len(pairs)
    classes = min(classes, max(size - 1, 1))
    of = np.zeros(size, np.int64)
    rank = np.argsort(-pairs.sum(1)[:-1], kind="stable")
    of[rank] = np.arange(size - 1) % classes
    of[-1] = classes
    member = np.eye(classes + 1)[of]
    out, into = pairs @ member, pairs.T @ member  # symbol to class, class to symbol
    sweep(of, rank, pairs, out, into, member.T @ out, sweeps)
    return of


@dataclass(frozen=True)
class Model:
    symbols: Symbols
    class_of: np.ndarray
    step: np.ndarray       # log10 of class transitions, before x after
    room: np.ndarray       # log10 of the emission denominators by class
    counts: np.ndarray     # of the frequent words
    end_count: int
    n: int
    v: int


def _ranked(counts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``(word, n, rank)`` of the words met ``least`` times, by falling count, then word; written."""
    sorted_ = written(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").select(
        "word", "n", F.monotonically_increasing_id().alias("place")), "ranked")
    part = F.shiftright("place", 33).cast("int")
    sizes = {r.part: r.n for r in sorted_.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for number in range(max(sizes, default=0) + 1):
        starts.append(starts[-1] + sizes.get(number, 0))
    start = F.element_at(F.array(*map(F.lit, starts)).cast("array<bigint>"), part + 1)
    rank = start + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.select("word", "n", rank.alias("rank")), starts[-1]


def _codes(batch: pa.RecordBatch, known: dict[bytes, int], end: int) -> tuple:
    """All words of some texts as one line with ``end`` before, between and after them: numbers of known
    words, ``-1 - i`` for the word ``rare[i]``."""
    get, number, line = known.get, {}, [end]
    for text in as_bytes(batch.column(0)):
        for word in words_of(text):
            code = get(word)
            if code is None:
                code = -1 - number.setdefault(word, len(number))
            line.append(code)
        line.append(end)
    return np.array(line, np.int64), list(number)


def _together(batches, rows: int = 400):
    """Batches cut to about ``rows`` rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _lists(of: np.ndarray, values: np.ndarray, size: int) -> pa.Array:
    """Arrow lists: the ``values`` of each of ``size`` rows, which ``of`` numbers."""
    order = np.argsort(of, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=size)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order]))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of all entries of a list column."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def word_pairs(docs: DataFrame, vocabulary: DataFrame, symbols: Symbols,
               numbers: Numbers) -> DataFrame:
    """All neighbours in the texts by number, packed for their blocks, see :func:`merged`.

    Frequent words are numbered where they are read.  Any other word meets its number in a
    join, together with the numbers beside it; two such words side by side take two joins.
    """
    known, end = symbols.words, symbols.end

    def blocks(dealt):
        at, data = list(zip(*dealt)) or ((), ())
        return at, data

    def scan(batches):
        lines, size = [], 0

        def flush():
            left, right = np.concatenate(lines, axis=1)
            at, data = blocks(deal(numbers, left, right, np.ones(len(left), np.int64)))
            # No word holds a space: a block has keys of its own in the join.
            none = pa.nulls(len(at), pa.list_(pa.int64()))
            return pa.record_batch([pa.array([b" %d" % a for a in at], pa.binary()),
                                    pa.array(at, pa.int32()), pa.array(data, pa.binary()),
                                    none, none], NEIGHBOURS)

        for batch in _together(batches):
            line, rare = _codes(batch, known, end)
            left, right = line[:-1], line[1:]
            both = (left >= 0) & (right >= 0)
            lines.append(np.stack([left[both], right[both]]))
            size += int(both.sum())
            if size >= PAIRS:
                yield flush()
                lines, size = [], 0
            if rare:
                one, two = (left >= 0) & (right < 0), (left < 0) & (right >= 0)
                yield pa.record_batch(
                    [pa.array(rare, pa.binary()), pa.nulls(len(rare), pa.int32()),
                     pa.nulls(len(rare), pa.binary()),
                     _lists(-1 - right[one], left[one], len(rare)),
                     _lists(-1 - left[two], right[two], len(rare))], NEIGHBOURS)
        if lines:
            yield flush()

    def beside(batches):
        """Pairs of words that are both not among the frequent ones."""
        for batch in _together(batches):
            line, rare = _codes(batch, known, end)
            at = np.flatnonzero((line[:-1] < 0) & (line[1:] < 0))
            words = pa.array(rare, pa.binary())
            code, n = np.unique((-1 - line[at]) * len(rare) - 1 - line[at + 1], return_counts=True)
            size = max(len(rare), 1)
            yield pa.record_batch([words.take(pa.array(code // size)),
                                   words.take(pa.array(code % size)), pa.array(n)],
                                  ["word", "after", "n"])

    def numbered(rank: pa.Array, word: pa.Array) -> np.ndarray:
        found = rank.fill_null(-1).to_numpy().copy()
        for at in np.flatnonzero(found < 0).tolist():
            found[at] = symbols.ending(word[at].as_py())
        return found

    def met(batches):
        held, size = [], 0

        def flush():
            return pa.record_batch([pa.array(c, k) for c, k in zip(blocks(deal(
                numbers, *np.concatenate(held, axis=1))), (pa.int32(), pa.binary()))],
                ["block", "data"])

        for batch in batches:
            packed = batch.column(1).is_valid()
            yield pa.record_batch([c.filter(packed) for c in batch.columns[1:3]], ["block", "data"])
            rest = batch.filter(pa.compute.invert(packed))
            if not rest.num_rows:
                continue
            number = numbered(rest.column(5), rest.column(0))
            for own, column in enumerate(rest.columns[3:5]):
                of, ids = _flat(column)
                mine = number[of]
                held.append(np.stack([mine, ids, np.ones(len(ids), np.int64)] if own else
                                     [ids, mine, np.ones(len(ids), np.int64)]))
                size += len(ids)
            if size >= PAIRS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def first(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(1), pa.array(numbered(batch.column(3), batch.column(0))),
                                   batch.column(2)], ["word", "before", "n"])

    def second(batches):
        for batch in batches:
            if batch.num_rows:
                at, data = blocks(deal(numbers, batch.column(1).to_numpy(),
                                       numbered(batch.column(3), batch.column(0)),
                                       batch.column(2).to_numpy()))
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(data, pa.binary())],
                                      ["block", "data"])

    text = docs.select("text")
    others = vocabulary.where(F.col("rank") >= len(known)).select("word", "rank")
    rows = arrow_stage(text, scan, "word binary, block int, data binary, before array<bigint>, "
                                   "after array<bigint>").join(others, "word", "left")
    pairs = arrow_stage(text, beside, "word binary, after binary, n bigint").join(others, "word", "left")
    half = arrow_stage(pairs, first, "word binary, before bigint, n bigint").join(others, "word", "left")
    schema = "block int, data binary"
    return merged(arrow_stage(rows, met, schema).unionByName(arrow_stage(half, second, schema)), numbers)


NEIGHBOURS = ["word", "block", "data", "before", "after"]


def train(docs: DataFrame, classes: int = 48, head: int = 1000, endings: int = 250,
          kept: int = 150_000, pull: float = 5.0, least: int = 2) -> tuple[Model, DataFrame]:
    """The model and the table ``(word, n, rank)`` of all training words, ``rank`` null for those
    met less than ``least`` times.

    All counts are over every text of ``docs`` (a column ``text``).  Every word met ``least``
    times is clustered by its own neighbours; any other word, seen or not, has the class of its
    ending, which is clustered by the words it stands for.  The driver clusters ``head`` words
    and the endings of all others first; from there all words move (:func:`settle`).  What
    reaches the driver: the ``kept`` most frequent words, two-byte endings, bigrams of ``head +
    endings`` symbols, and the class of each word, a byte or two.
    """
    counts = written(word_counts(docs), "words")
    tail = F.expr("substring(word, -2, 2)").alias("ending")
    rare = F.col("n") < least
    by_ending, once = {}, {}
    for r in counts.groupBy(tail).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(rare, 1)).alias("once")).collect():
        by_ending[bytes(r.ending)], once[bytes(r.ending)] = (r.n, r.v), r.once
    vocabulary, size = _ranked(counts, least)
    frequent = [(bytes(r.word), r.n) for r in vocabulary.where(F.col("rank") < kept).orderBy(
        "rank").toLocalIterator()]
    texts, v = docs.count(), sum(v for _, v in by_ending.values())
    top = frequent[:head]
    for word, n in top:
        total, distinct = by_ending[word[-2:]]
        by_ending[word[-2:]] = total - n, distinct - 1
    ranked = sorted((e for e, (n, _) in by_ending.items() if n),
                    key=lambda e: (-by_ending[e][0], e))[:endings]
    start = Symbols({w: i for i, (w, _) in enumerate(top)},
                    {e: len(top) + i for i, e in enumerate(ranked)}, len(top))
    found = symbol_bigrams(docs, start).toArrow()
    pairs = np.zeros((start.end + 1) ** 2)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    first = exchange(pairs.reshape(start.end + 1, -1), classes)
    symbols = Symbols({w: i for i, (w, _) in enumerate(frequent)},
                      {e: size + i for i, e in enumerate(ranked)}, size)
    classes = int(first.max())  # that of the end
    of = np.append(_starting(vocabulary, start, first, size), first[len(top):])
    numbers = Numbers(len(top), size, symbols.end + 1,
                      -(-sum(n for n, _ in by_ending.values()) // PLACES) + 1)
    of, table = settle(word_pairs(docs, vocabulary, symbols, numbers), numbers, of, classes)
    total = table.sum(0)
    types = np.ones(symbols.end + 1)
    types[size:symbols.other] = [once[e] for e in ranked]
    types[symbols.other] = sum(n for e, n in once.items() if e not in symbols.endings)
    types[symbols.end] = bool(texts)
    distinct = np.bincount(of, types, classes + 1)
    share = (total + ADD) / (total + ADD).sum()
    step = (table + pull * share) / (table.sum(1, keepdims=True) + pull)
    model = Model(symbols, of, np.log10(step), np.log10(total + ADD * (distinct + 1)),
                  np.array([n for _, n in frequent], np.int64), texts, int(total.sum()),
                  v + bool(texts))
    return model, counts.where(rare).select("word", "n", F.lit(None).cast("bigint").alias(
        "rank")).unionByName(vocabulary)


def _starting(vocabulary: DataFrame, start: Symbols, first: np.ndarray, size: int) -> np.ndarray:
    """The class of each word's symbol among the first ones, by rank."""
    kind = np.min_scalar_type(int(first.max()))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rank = batch.column(1).to_numpy()
                found = np.array([first[start.of(w)] for w in batch.column(0).to_pylist()], kind)
                yield pa.record_batch([pa.array([rank.astype(np.int64).tobytes()]),
                                       pa.array([found.tobytes()])], ["rank", "found"])

    of = np.zeros(size, np.int64)
    for r in arrow_stage(vocabulary.select("word", "rank"), run,
                         "rank binary, found binary").toLocalIterator():
        of[np.frombuffer(bytes(r.rank), np.int64)] = np.frombuffer(bytes(r.found), kind)
    return of


def _rows(source: DataFrame, model: Model) -> DataFrame:
    """One row per text, and one per text and word that is not among the frequent ones.

    A text's row has a key that no word can equal, so one join serves both and neither kind
    gathers on one key.  A word's row has the classes before and after it; where two such words
    are neighbours, their numbers in the text are in ``links`` of the text's row.
    """
    symbols = model.symbols
    known, end_class = symbols.words, int(model.class_of[symbols.end])
    own_class = model.class_of[:len(known)]
    edge = len(known)

    def run(batches):
        logs = np.append(np.log10(model.counts + ADD), np.log10(model.end_count + ADD))
        group = np.append(own_class, end_class)
        for batch in _together(batches):
            texts = batch.num_rows
            line, rare = _codes(batch.select([2]), known, edge)
            left, right = line[:-1], line[1:]
            text = np.cumsum(line == edge)[:-1] - 1  # of the word to the right
            tokens = np.bincount(text, minlength=texts)
            fixed = right >= 0
            base = np.bincount(text[fixed], logs[right[fixed]], texts)
            both = fixed & (left >= 0)
            path = np.bincount(text[both], model.step[group[left[both]], group[right[both]]], texts)
            path -= np.bincount(text[fixed], model.room[group[right[fixed]]], texts)
            number, ids = batch.column(0).to_numpy(), batch.column(1)
            # Words of a text that are not frequent, each numbered once.
            at = np.flatnonzero(~fixed)
            size = max(len(rare), 1)
            code, of, n = np.unique(text[at] * size - 1 - right[at], return_inverse=True,
                                    return_counts=True)
            place = np.full(len(right), -1)
            place[at] = of
            heads = code // size
            starts = np.searchsorted(heads, np.arange(texts))
            after_rare = np.append(-1, place[:-1])  # number of the word to the left
            before_one, after_one = ~fixed & (left >= 0), fixed & (left < 0)
            linked = np.flatnonzero(~fixed & (left < 0))
            links = np.stack([after_rare[linked], place[linked]]) - starts[text[linked]]
            asked = np.full(len(code), -1)
            asked[after_rare[linked]], asked[place[linked]] = links
            yield pa.record_batch([
                pa.array([b" %d" % x for x in number.tolist()], pa.binary()), batch.column(0), ids,
                pa.array(tokens), pa.nulls(texts, pa.int64()),
                pa.array(np.bincount(text[fixed & (right < edge)], minlength=texts)
                         + (model.end_count > 0)),
                pa.array(base), pa.array(path), *[pa.nulls(texts, pa.list_(pa.int64()))] * 2,
                _lists(np.repeat(text[linked], 2), links.T.ravel(), texts)], MET)
            many = len(code)
            yield pa.record_batch([
                pa.array(rare, pa.binary()).take(pa.array(code % size)), pa.array(number[heads]),
                pa.nulls(many, pa.int64()), pa.array(n), pa.array(asked),
                pa.array(n * 0), pa.array(n * 0.0), pa.array(n * 0.0),
                _lists(place[before_one], group[left[before_one]], many),
                _lists(after_rare[after_one], group[right[after_one]], many),
                pa.nulls(many, pa.list_(pa.int64()))], MET)

    return arrow_stage(source, run, MET_SCHEMA)
MET = ["word", "row_no", "id", "tokens", "place", "known", "line", "path", "before", "after", "links"]
MET_SCHEMA = ("word binary, row_no bigint, id bigint, tokens bigint, place bigint, known bigint, "
              "line double, path double, before array<bigint>, after array<bigint>, links array<bigint>")
SUMS = ("row_no bigint, id bigint, tokens bigint, known bigint, line double, path double, "
        "spots array<bigint>, links array<bigint>")


def _resolved(met: DataFrame, model: Model) -> DataFrame:
    """Sums by text of the rows of a task, joined with ``(n, rank)``.  ``spots`` are ``place * classes +
    class`` of the words that ``links`` name."""
    symbols, wide = model.symbols, len(model.room)
    sent = met.sparkSession.sparkContext.broadcast(model.class_of.astype(np.min_scalar_type(wide)))
    names = [c.split()[0] for c in SUMS.split(", ")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            word, number, ids, tokens, place, known, line, path, before, after, links, n, rank = batch.columns
            whole = place.is_null().to_numpy(zero_copy_only=False)
            rank = rank.fill_null(-1).to_numpy().copy()
            for at in np.flatnonzero(~whole & (rank < 0)).tolist():
                rank[at] = symbols.ending(word[at].as_py())
            group = sent.value[rank].astype(np.int64)
            count, n = tokens.to_numpy(), n.fill_null(0).to_numpy()
            line = line.to_numpy() + np.where(whole, 0.0, count * np.log10(n + ADD))
            path = path.to_numpy() - np.where(whole, 0.0, count * model.room[group])
            for steps, column in ((model.step, before), (model.step.T, after)):
                of, other = _flat(column)
                path += np.bincount(of, steps[other, group[of]], len(path))
            known = known.to_numpy() + np.where(~whole & (n > 0), count, 0)
            place = place.fill_null(-1).to_numpy()
            # One row a text.
            number = number.to_numpy()
            texts, of = np.unique(number, return_inverse=True)
            size = len(texts)
            first = np.full(size, -1)
            first[of[whole]] = np.flatnonzero(whole)
            there = pa.array(first >= 0)
            at = pa.array(np.maximum(first, 0))
            named = np.flatnonzero(place >= 0)
            none = pa.scalar(None, pa.int64())
            yield pa.record_batch([
                pa.array(texts), pa.compute.if_else(there, ids.take(at), none),
                pa.compute.if_else(there, tokens.take(at), none),
                pa.array(np.bincount(of, known, size).astype(np.int64)),
                pa.array(np.bincount(of, line, size)), pa.array(np.bincount(of, path, size)),
                _lists(of[named], place[named] * wide + group[named], size),
                _lists(of[(at := _flat(links))[0]], at[1], size)], names)

    return arrow_stage(met, run, SUMS)


def _summed(resolved: DataFrame, model: Model) -> DataFrame:
    """``(id, n_tokens, n_known, line, path)`` of each text."""
    wide = len(model.room)
    names = ["id", "n_tokens", "n_known", "line", "path"]

    def run(batches):
        for joined in whole_groups(batches, ["row_no"], 20_000):
            of = group_ids(joined, ["row_no"])
            size = int(of[-1]) + 1
            tokens = joined["tokens"].combine_chunks()
            whole = tokens.is_valid()
            sums = [np.bincount(of, joined[c].to_numpy(), size) for c in ("known", "line", "path")]
            (row, link), (held, spot) = (_flat(joined[c].combine_chunks()) for c in ("links", "spots"))
            if len(link):
                # Place of a word in its text: its class.
                most = int(max(link.max(), (spot // wide).max())) + 1
                code = of[held] * most + spot // wide
                order = np.argsort(code)
                asked = of[row] * most + link
                found = (spot % wide)[order][np.searchsorted(code[order], asked)]
                sums[2] += np.bincount(of[row[::2]], model.step[found[::2], found[1::2]], size)
            yield pa.record_batch([
                joined["id"].combine_chunks().filter(whole), tokens.filter(whole),
                pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names)

    parts = resolved.repartition("row_no").sortWithinPartitions("row_no")
    return arrow_stage(parts, run, "id bigint, n_tokens bigint, n_known bigint, line double, path double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                **settings) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    The model learns from the rows whose id is outside the held-out fold.  ``score`` is the
    log10 probability of the whole text under class transitions and word emissions, each
    class keeping room for one unseen word; ``base_score`` is that of single words.  Counts
    of frequent words travel with the tasks; other words meet the full table of counts and
    numbers in a join, so no count and no class is cut off.  Null and empty texts are one end token; null ids and
    repeated rows keep their rows; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"),
                         F.col(text_col).cast("string").alias("text"))
    model, counts = train(source.where(remainder(F.col("id")) != FOLD), **settings)
    rows = _rows(source.select(F.monotonically_increasing_id().alias("row_no"), "id", "text"), model)
    others = counts.where(F.col("rank").isNull() | (F.col("rank") >= len(model.counts)))
    summed = _summed(_resolved(rows.join(others, "word", "left").select(*MET, "n", "rank"), model), model)
    room = float(np.log10(model.n + ADD * (model.v + 1)))
    return summed.select(
        "id", (remainder(F.col("id")) == FOLD).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("line") - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (F.col("line") + F.col("path")).alias("score"))
