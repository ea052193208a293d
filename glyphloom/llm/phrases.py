"""Phrase collocations from depth-truncated suffix subtrees, partitioned by word prefix."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphloom.llm.common import arrow_stage, as_bytes
from glyphloom.session import checkpointed

SLOTS = 1 << 24       # bits of the map of frequent words: 2 MB whatever the corpus
HELD = 250_000        # distinct words that one task holds
PLACES = 1_500_000    # places that one task adds up before it writes them
STRETCH = 1 << 20     # bytes of a text cut into words at once
HOT = 4096            # a word with more than one in so many of all words is extended
BREAK = b"\n"
# Fixed characters: A-Z fall to a-z, the ends of pieces to a line feed, tab to space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t",
                        b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def word_runs(text: bytes, keep: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in stretches, ``BREAK`` between pieces.

    Yields ``(words, starts)``: the phrases that begin at the first ``starts`` words lie
    within ``words``.  The last ``keep`` words of a stretch come again in the next one.
    """
    at, carried = 0, []
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in b" \t\n.") + 1
            while cut <= at and end < len(text):  # one word longer than a stretch
                end += STRETCH
                cut = max(text.rfind(c, at, end) for c in b" \t\n.") + 1
            end = min(cut if cut > at else end, len(text))
        part = text[at:end].translate(_FOLD).replace(BREAK, b" \n ")
        words = carried + [w for w in part.split(b" ") if w]
        at = end
        starts = len(words) if at >= len(text) else max(len(words) - keep, 0)
        yield words, starts
        carried = words[starts:]


def _slot(lang: bytes, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang + b"\0")) % SLOTS


def _word_counts(source: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of all words."""
    def flush(counts):
        langs, found = zip(*counts) if counts else ((), ())
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(found, pa.binary()),
                                pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches):
        total: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                counts = total.setdefault(lang, Counter())
                before = len(counts)
                for words, starts in word_runs(text, 1):
                    counts.update(words[:starts])
                size += len(counts) - before
                if size >= HELD:
                    yield flush({(x, w): n for x, c in total.items() for w, n in c.items()
                                 if w != BREAK})
                    total, size = {}, 0
        yield flush({(x, w): n for x, c in total.items() for w, n in c.items() if w != BREAK})

    return arrow_stage(source, run, "lang string, word binary, n bigint").groupBy(
        "lang", "word").agg(F.sum("n").alias("n"))


def _frequent(words: DataFrame) -> np.ndarray:
    """A bit for each slot that holds a frequent word; others may share it, so it only rules
    words out."""
    slot = F.pmod(F.crc32(F.concat(F.encode("lang", "utf-8"), F.unhex(F.lit("00")), "word")),
                  F.lit(SLOTS))
    rows = words.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("block")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) AS int)))").alias("bits"))
    bits = np.zeros(SLOTS // 64, np.int64)
    for r in rows.toLocalIterator():  # at most SLOTS / 64 rows
        bits[r.block] = r.bits
    return bits.view(np.uint64)


def _suffixes(source: DataFrame, bits: np.ndarray, hot: dict[str, set[bytes]], groups: int,
              longest: int) -> DataFrame:
    """``(part, stem, w3, ..., n)``: at each place where two frequent words meet, both with
    the language (the stem) and the words after them as far as they are frequent.

    ``part`` is the group of the prefix: the first word, or two where the first is hot.
    Words have numbers inside a task, so equal suffixes are found and added up as numbers.
    """
    later = [f"w{m}" for m in range(3, longest + 1)]

    def flush(lang, table, held):
        words, marks, warm = table
        found, n = _distinct(np.concatenate(held))
        first, second, *rest = found.T
        named, mark = pa.array(words, pa.binary()), np.array(marks, np.int64)
        part = np.where(np.array(warm)[first], mark[first] * 1_000_003 ^ mark[second], mark[first])
        space, name = pa.scalar(b" ", pa.binary()), pa.scalar(lang.encode(), pa.binary())
        stem = pc.binary_join_element_wise(named.take(pa.array(first)), named.take(pa.array(second)),
                                           name, space)
        others = [pc.if_else(pa.array(w > 0), named.take(pa.array(w)), None) for w in rest]
        for at in range(0, len(n), 200_000):
            yield pa.record_batch([pa.array((part % groups).astype(np.int32)), stem, *others,
                                   pa.array(n)], ["part", "stem", *later, "n"]).slice(at, 200_000)

    def run(batches):
        tables: dict[str, tuple] = {}
        numbers: dict[str, dict[bytes, int]] = {}
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                for found, starts in word_runs(text, longest - 1):
                    known = numbers.setdefault(lang, {})
                    # Number 0 stands for all that ends a phrase.
                    words, marks, warm = tables.setdefault(lang, ([b""], [0], [False]))
                    for w in set(found).difference(known):
                        slot = _slot(lang.encode(), w)
                        known[w] = 0
                        if w != BREAK and int(bits[slot >> 6]) >> (slot & 63) & 1:
                            known[w] = len(words)
                            words.append(w)
                            marks.append(zlib.crc32(w))
                            warm.append(w in hot.get(lang, ()))
                    ids = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                    ids = np.append(ids, np.zeros(longest, np.int32))
                    suffix = np.stack([ids[j:j + starts] for j in range(longest)], 1)
                    suffix = suffix[(suffix[:, 0] > 0) & (suffix[:, 1] > 0)]
                    for j in range(3, longest):
                        suffix[suffix[:, j - 1] == 0, j] = 0
                    held.setdefault(lang, []).append(suffix)
                    size += len(suffix)
                    if size >= PLACES or sum(map(len, numbers.values())) >= HELD:
                        for x, part in held.items():
                            yield from flush(x, tables[x], part)
                        tables, numbers, held, size = {}, {}, {}, 0
        for x, part in held.items():
            yield from flush(x, tables[x], part)

    return arrow_stage(source, run, "part int, stem binary, "
                       + "".join(f"{w} binary, " for w in later) + "n bigint")


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of numbers below 2**21, and how often each occurs."""
    code = rows[:, 0].astype(np.int64)
    for j in range(1, rows.shape[1]):
        if j > 2:  # three numbers fit into 63 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code << 21 | rows[:, j]
    if rows.shape[1] <= 3:
        code, n = np.unique(code, return_counts=True)
        last = rows.shape[1] - 1
        return np.stack([code >> 21 * (last - j) & (1 << 21) - 1 for j in range(last + 1)], 1), n
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return rows[first].astype(np.int64), n


def _subtrees(suffixes: DataFrame, groups: int, least: int, longest: int) -> DataFrame:
    """``(lang, phrase, size, a)``: the nodes of two or more words with ``least`` occurrences.

    The suffixes of a group arrive sorted, which is the order of the leaves of its subtree.
    Equal ones are added up to leaves, and a node has the total of the leaves from its first
    to its last; of an unfinished stem its leaves are kept for the next batch.
    """
    words = ["stem", *(f"w{m}" for m in range(3, longest + 1))]
    names = ["lang", "phrase", "size", "a"]
    kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64()]

    def changes(table, depth):
        """Where a node of ``depth`` columns begins."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for name in words[:depth]:
            column = pc.fill_null(table[name].combine_chunks(), b" ")  # no word is a space
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(
                zero_copy_only=False)
        return np.flatnonzero(new)

    def leaves(table):
        heads = changes(table, len(words))
        total = np.add.reduceat(table["n"].to_numpy(), heads)
        return pa.table([table[w].take(pa.array(heads)) for w in words] + [pa.array(total)],
                        [*words, "n"])

    def nodes(table):
        rows, n = [], table["n"].to_numpy()
        for depth in range(1, len(words) + 1):
            heads = changes(table, depth)
            total = np.add.reduceat(n, heads)
            heads, total = heads[total >= least], total[total >= least]
            picked = table.take(pa.array(heads))
            for *branch, a in zip(*(picked[w].to_pylist() for w in words[:depth]), total.tolist()):
                if branch[-1] is not None:
                    first, second, lang = branch[0].split(b" ", 2)
                    rows.append((lang.decode(), b" ".join((first, second, *branch[1:])), depth + 1, a))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = leaves(pa.concat_tables([kept, table]) if kept else table).combine_chunks()
            cut = int(changes(table, 1)[-1])
            if cut:
                yield nodes(table.slice(0, cut))
            kept = table.slice(cut)
        if kept:
            yield nodes(kept)

    # One group a task, by number: hashed numbers would put several into one.
    dealt = suffixes.repartitionById(groups, F.col("part")).sortWithinPartitions(*words)
    return arrow_stage(dealt.select(*words, "n"), run,
                       "lang string, phrase binary, size int, a bigint")


def _part(words: Column, first, count) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def top_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10,
                longest: int = 3, inside: int = 50, top: int = 2000,
                budget: int = 2_000_000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    A-Z are lower-cased, texts cut into pieces at ``.,;:!?`` and line ends, pieces into
    words at spaces and tabs.  Candidates have 2 to ``longest`` words and at least ``least``
    occurrences ``a`` within pieces.  A candidate is cut after its first words where
    ``floor(1000000 a a / (l r))`` is least, ``l`` and ``r`` the counts of both parts (ties:
    fewest first words); it goes if a longer candidate holds it and has at least ``inside``
    percent of its occurrences.  Order: score, ``a``, phrase as bytes.

    Vertical partitioning: words are counted first; each place then gives its suffix of up
    to ``longest`` words, cut before a word that is rarer than ``least``, to the group of its
    prefix.  Groups hold about ``budget`` places; a word with more than a quarter of that is
    extended by the next word, so that no group rests on one word (at most ``HOT`` words are,
    those with more than one in ``HOT`` of all).  Each task adds up equal suffixes
    before it sends them, and every group is built into the truncated suffix subtree by
    itself; all counts are totals of its leaves.

    Null text has no words, null language is ``und``.  Rows count as often as they occur.
    Texts are read whole, long ones in stretches.  A language without a candidate has no
    row; an empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                         F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    words = checkpointed(_word_counts(source))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    groups = 4 * max(1, -(-total // budget))
    hot: dict[str, set[bytes]] = {}
    for r in frequent.where(F.col("n") > max(budget // 4, total // HOT)).select(
            "lang", "word").collect():
        hot.setdefault(r.lang, set()).add(bytes(r.word))
    nodes = checkpointed(_subtrees(_suffixes(source, _frequent(frequent), hot, groups, longest),
                                   groups, least, longest))
    candidates = nodes.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "a")
    known = candidates.select("lang", "phrase", "a").unionAll(
        frequent.select("lang", F.col("word").cast("string"), "n"))
    return _ranked(candidates, known, sizes, inside, top)


def _ranked(candidates: DataFrame, known: DataFrame, sizes: DataFrame, inside: int,
            top: int) -> DataFrame:
    counts = known.select("lang", F.col("phrase").alias("piece"), F.col("a").alias("f"))
    split = candidates.withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "a", "w", "size",
                        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select(
        "lang", "phrase", "a", "k", F.explode(F.array(
            F.struct(F.lit(True).alias("front"), _part(F.col("w"), F.lit(1), F.col("k")).alias("piece")),
            F.struct(F.lit(False).alias("front"), _part(
                F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("piece")))).alias("s")
    ).select("lang", "phrase", "a", "k", "s.*")
    found = sides.join(counts, ["lang", "piece"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("front"), F.col("f"))).alias("l"),
        F.max(F.when(~F.col("front"), F.col("f"))).alias("r"))
    # Decimals of 38 digits hold the products; a is at most l and r, so the score is a long.
    a, left, right = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    score = F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)
    best = found.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m")).select(
        "lang", "phrase", "a", "m.l", "m.r", "m.score")
    # Every shorter stretch of two or more words inside a candidate.
    span = split.where("size > 2").select(
        "lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    parts = span.select("lang", "a", "w", "m", F.explode(
        F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")).select(
        "lang", _part(F.col("w"), F.col("at"), F.col("m")).alias("phrase"), "a")
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * inside)).drop("held")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within parts of a language, so that no task sorts all of its candidates.
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(
        F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
