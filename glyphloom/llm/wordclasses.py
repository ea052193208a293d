"""Exchange clustering of a whole vocabulary: pairs of neighbours in blocks of words, a round at a time.

Symbols are numbered: words by falling frequency, then word endings, one for any other word,
and the end of a text.  The ``top`` first words and all symbols after the words are *hot*: their
pairs are found beside the other word of the pair, so no block holds a frequent symbol's row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage
from glyphloom.session import written

PAIRS = 1_500_000  # pairs that are sorted at a time
PLACES = 750_000   # places in the texts for each block
LEVELS = 48        # counts whose gains are looked up
DENSE = 4          # counts whose gains are added up for all words at once
ROWS = 2_000       # gains that are added up at a time, few enough for the cache
_ODD = 0x9E3779B97F4A7C15
SETTLED = 1e-3     # two rounds that raise the likelihood by a smaller share are the last


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


@dataclass(frozen=True)
class Numbers:
    """How symbols are numbered and dealt to blocks."""

    top: int
    words: int
    size: int
    blocks: int

    @property
    def hot(self) -> int:
        return self.top + self.size - self.words

    def cold(self, ids: np.ndarray) -> np.ndarray:
        return (ids >= self.top) & (ids < self.words)

    def hot_row(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.top, ids, ids - self.words + self.top)

    def hot_ids(self) -> np.ndarray:
        return np.append(np.arange(self.top), np.arange(self.words, self.size))


def pack(key: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join((
        key.astype(np.uint32).tobytes(), other.astype(np.uint32).tobytes(),
        n.astype(np.int64).tobytes())))


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(data)
    count = len(plain) // 16
    ids = np.frombuffer(plain, np.uint32, 2 * count)
    return np.stack([ids[:count], ids[count:], np.frombuffer(plain, np.int64, count, 8 * count)])


def _counted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sums of their ``n``."""
    if not len(code):
        return code, n
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n[order], first)


def deal(numbers: Numbers, left: np.ndarray, right: np.ndarray,
         n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Neighbours ``left`` and ``right`` and how often they meet, as packed rows of blocks.

    A block has, for each of its words and either side, the other symbol and the count; block
    -1 has the pairs of hot symbols.
    """
    code, n = _counted(left * numbers.size + right, n)
    left, right = code // numbers.size, code % numbers.size
    is_left, is_right = numbers.cold(left), numbers.cold(right)
    both_hot = ~is_left & ~is_right
    if both_hot.any():
        yield -1, pack(numbers.hot_row(left[both_hot]), numbers.hot_row(right[both_hot]),
                       n[both_hot])
    word = np.concatenate([right[is_right], left[is_left]])
    other = np.concatenate([left[is_right], right[is_left]])
    side = np.repeat(np.array([0, 1]), [is_right.sum(), is_left.sum()])
    n = np.concatenate([n[is_right], n[is_left]])
    block = word % numbers.blocks
    order = np.lexsort((other, word, block))
    cuts = np.searchsorted(block[order], np.arange(numbers.blocks + 1))
    key = word // numbers.blocks * 2 + side
    for at in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[at]:cuts[at + 1]]
        yield at, pack(key[rows], other[rows], n[rows])


def merged(dealt: DataFrame, numbers: Numbers) -> DataFrame:
    """``(block, data)`` with one row for each block, its equal pairs added up; the table is written."""
    def run(batches):
        held: list[np.ndarray] = []
        now = None

        def flush():
            key, other, n = np.concatenate(held, axis=1)
            span = numbers.hot if now == -1 else numbers.size
            code, n = _counted(key * span + other, n)
            return pa.record_batch([pa.array([now], pa.int32()), pa.array(
                [pack(code // span, code % span, n)], pa.binary())], ["block", "data"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now and held:
                    yield flush()
                    held.clear()
                now = block
                held.append(unpack(data.as_py()))
        if held:
            yield flush()

    parts = dealt.repartition(min(numbers.blocks + 1, 2000), "block").sortWithinPartitions("block")
    return written(arrow_stage(parts, run, "block int, data binary"), "pairs")


def propose(right: np.ndarray, left: np.ndarray, own: np.ndarray, of: np.ndarray,
            table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the class that raises the likelihood most if it alone moves, and by how much.

    ``right`` and ``left`` count the classes after and before it, without itself, which follows
    itself ``own`` times; ``of`` is its class, ``table`` counts class after class.  The last class,
    that of the end, takes no symbol.
    """
    count, classes = len(own), len(table) - 1
    gain = np.zeros((count, classes))
    rows, columns = table.sum(1), table.sum(0)
    every = np.arange(count)
    entries = []
    for hist, t in ((right, table), (left, table.T)):
        base = xlogx(t)
        levels = np.stack([(xlogx(t + m) - base).T[:, :classes] for m in range(LEVELS + 1)])
        i, c = np.nonzero(hist)
        m = hist[i, c]
        entries.append((i, c, m))
        # What the symbol adds to the row of any class; counts met often as one product.
        for level in range(1, DENSE + 1):
            gain += (hist == level).astype(float) @ levels[level]
        more = np.flatnonzero(m > DENSE)
        for low in range(0, len(more), ROWS):
            x, y, z = (v[more[low:low + ROWS]] for v in (i, c, m))
            added = levels[np.minimum(z, LEVELS).astype(np.int64), y]
            big = np.flatnonzero(z > LEVELS)
            if len(big):
                cells = t.T[y[big], :classes]
                added[big] = xlogx(cells + z[big][:, None]) - base.T[y[big], :classes]
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            gain[x[first]] += np.add.reduceat(added, first)
    for (hist, t), (i, b, m) in zip(((right, table), (left, table.T)), entries[::-1]):
        # The row of its own class has lost the symbol.
        a = of[i]
        add = hist[i, a]
        at = np.flatnonzero((add > 0) & (b != a) & (b < classes))
        i, b, m, a, add = i[at], b[at], m[at], a[at], add[at]
        cell = t[b, a]
        gain[i, b] += xlogx(cell - m + add) - xlogx(cell - m) - xlogx(cell + add) + xlogx(cell)
    corner = np.diag(table)
    i, b, m = entries[0]
    at = np.flatnonzero((left[i, b] > 0) & (own[i] == 0) & (b < classes))
    i, b, m = i[at], b[at], m[at]
    for x, y in ((i, b), tuple(c.ravel() for c in np.meshgrid(
            np.flatnonzero(own), np.arange(classes), indexing="ij"))):
        r, l, c = right[x, y], left[x, y], corner[y]
        gain[x, y] += xlogx(c + r + l + own[x]) + xlogx(c) - xlogx(c + r) - xlogx(c + l)
    uses = right.sum(1) + own
    kinds, kind = np.unique(uses, return_inverse=True)
    lost = (xlogx(rows[:classes] + kinds[:, None]) - xlogx(rows[:classes])
            + xlogx(columns[:classes] + kinds[:, None]) - xlogx(columns[:classes]))
    gain -= lost[kind.ravel()]
    # What it adds where it is.
    a = of
    stay = (xlogx(corner[a]) - xlogx(corner[a] - right[every, a] - left[every, a] - own)
            - xlogx(rows[a]) + xlogx(rows[a] - uses) - xlogx(columns[a]) + xlogx(columns[a] - uses))
    for t, (i, c, m) in zip((table, table.T), entries):
        elsewhere = c != of[i]
        i, c, m = i[elsewhere], c[elsewhere], m[elsewhere]
        cell = t[of[i], c]
        stay += np.bincount(i, xlogx(cell) - xlogx(cell - m), count)
    gain[every, np.minimum(of, classes - 1)] = stay
    best = np.argmax(gain, 1)
    raised = gain[every, best] - stay
    raised[(of == classes) | (uses == 0)] = 0
    return best, raised


def sweep(of: np.ndarray, rank: np.ndarray, pairs: np.ndarray, out: np.ndarray, into: np.ndarray,
          table: np.ndarray, sweeps: int | None = None) -> None:
    """Move symbols one after the other, in the order ``rank``, each to its best class, until a sweep
    moves none.  ``out`` and ``into`` count the classes after and before a symbol, ``pairs`` the
    symbols among each other; ``of``, these and ``table`` are brought up to date."""
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for w in rank.tolist():
            a, own = of[w], pairs[w, w]
            right, left = out[w].copy(), into[w].copy()
            right[a] -= own
            left[a] -= own
            if not (right.any() or left.any() or own):
                continue
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows, columns = table.sum(1) + left, table.sum(0) + right
            gain = ((xlogx(table + right) - xlogx(table)).sum(1)
                    + (xlogx(table.T + left) - xlogx(table.T)).sum(1))
            corner = np.diag(table)
            gain += (xlogx(corner + right + left + own) + xlogx(corner)
                     - xlogx(corner + right) - xlogx(corner + left))
            n_right, n_left = right.sum() + own, left.sum() + own
            gain -= xlogx(rows + n_right) - xlogx(rows) + xlogx(columns + n_left) - xlogx(columns)
            gain[-1] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                out[:, a] -= pairs[:, w]
                out[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
        if not moved:
            break


def _sums(pairs: DataFrame, numbers: Numbers, of: np.ndarray, classes: int,
          table: np.ndarray | None) -> Iterable[tuple[str, bytes]]:
    """What the blocks give: the class table, or, given that, histograms of hot symbols and the moves
    of the words."""
    spark = pairs.sparkSession
    sent = spark.sparkContext.broadcast(of.astype(np.min_scalar_type(classes)))
    wide = classes + 1

    def run(batches):
        of = sent.value.astype(np.int64)
        total = np.zeros(wide * wide)
        hists = np.zeros((2, numbers.hot * wide))
        moves = []
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, other, n = unpack(data.as_py())
                if block == -1:
                    ids = numbers.hot_ids()
                    before, after = of[ids[key]], of[ids[other]]
                    if table is None:
                        total += np.bincount(before * wide + after, n, wide * wide)
                    else:
                        apart = np.flatnonzero(key != other)
                        hists[0] += np.bincount((key * wide + after)[apart], n[apart], hists.shape[1])
                        hists[1] += np.bincount((other * wide + before)[apart], n[apart],
                                                hists.shape[1])
                    continue
                word, side = (key >> 1) * numbers.blocks + block, key & 1
                mine, its = of[word], of[other]
                near = np.flatnonzero(~numbers.cold(other))
                if table is None:
                    once = side == 1
                    total += np.bincount((mine * wide + its)[once], n[once], wide * wide)
                    once = near[side[near] == 0]
                    total += np.bincount((its * wide + mine)[once], n[once], wide * wide)
                    continue
                cell = numbers.hot_row(other[near]) * wide + mine[near]
                for s in (0, 1):
                    at = side[near] == s
                    hists[s] += np.bincount(cell[at], n[near][at], hists.shape[1])
                count = int(key[-1] >> 1) + 1
                itself = np.flatnonzero((word == other) & (side == 1))
                own = np.zeros(count)
                own[key[itself] >> 1] = n[itself]
                apart = np.flatnonzero(word != other)
                hist = np.bincount((key * wide + its)[apart], n[apart], 2 * count * wide).reshape(
                    count, 2, wide)
                ids = np.arange(count) * numbers.blocks + block
                best, gain = propose(hist[:, 1], hist[:, 0], own, of[ids], table)
                at = np.flatnonzero(gain > 1e-6)
                moves.append((ids[at].astype(np.int32), best[at].astype(np.int16)))
        if table is None:
            rows = [("table", total.tobytes())]
        else:
            columns = [np.concatenate(c).tobytes() for c in zip(*moves)] if moves else [b""] * 2
            cells = np.flatnonzero(hists.ravel())
            rows = [("hot", pack(cells, cells * 0, hists.ravel()[cells])),
                    *zip(("ids", "best"), columns)]
        yield pa.record_batch([pa.array([k for k, _ in rows]), pa.array(
            [v for _, v in rows], pa.binary())], ["kind", "data"])

    found = [(r.kind, bytes(r.data)) for r in arrow_stage(
        pairs, run, "kind string, data binary").collect()]
    sent.destroy()
    return found


def _table(pairs, numbers, of, classes) -> np.ndarray:
    found = [np.frombuffer(d) for _, d in _sums(pairs, numbers, of, classes, None)]
    return np.sum(found, 0).reshape(classes + 1, classes + 1) if found else np.zeros((classes + 1,) * 2)


def _moves(pairs, numbers, of, classes, table, hot: np.ndarray) -> tuple:
    """Classes and class table once the hot symbols, which meet each other ``hot`` times, have moved in
    turn; then the other words that gain by moving, and where to."""
    found = _sums(pairs, numbers, of, classes, table)
    ids, best = (np.frombuffer(b"".join(d for k, d in found if k == name), kind)
                 for name, kind in (("ids", np.int32), ("best", np.int16)))
    hists = np.zeros(2 * numbers.hot * (classes + 1))
    for cells, _, n in (unpack(d) for k, d in found if k == "hot"):
        hists[cells] += n
    out, into = hists.reshape(2, numbers.hot, classes + 1)
    mine = numbers.hot_ids()
    own = np.arange(numbers.hot), of[mine]
    out[own] += np.diag(hot)
    into[own] += np.diag(hot)
    moved, table, of = of[mine], table.copy(), of.copy()
    sweep(moved, np.argsort(-out.sum(1)[:-1], kind="stable"), hot, out, into, table, 1)
    of[mine] = moved
    return of, table, ids, best


def likelihood(table: np.ndarray) -> float:
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def settle(pairs: DataFrame, numbers: Numbers, of: np.ndarray,
           classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols and their class table, from classes ``of`` to begin with.

    In a round the hot symbols move one after the other, and of the other words each names the class
    that raises the likelihood most with all others in place; those that gain move together.  If
    that raises it not at all, a quarter of them drawn by number and round is tried, and so on; the next
    round begins with four times the share that did.  The
    last round is the second in a row that raises the likelihood by less than ``SETTLED`` of what
    classes have gained over none.
    """
    hot = np.zeros((numbers.hot, numbers.hot))
    for row in pairs.where("block = -1").collect():
        key, other, n = unpack(bytes(row.data))
        hot[key, other] += n
    table = _table(pairs, numbers, of, classes)
    value, none = likelihood(table), -float(xlogx(table.sum()))
    share, low = 1.0, 0
    for turn in count(1):
        before = value
        of, table, ids, best = _moves(pairs, numbers, of, classes, table, hot)
        value, take = likelihood(table), int(np.ceil(share * len(ids)))
        drawn = np.lexsort((ids, ids.astype(np.uint64) * np.uint64(_ODD * (2 * turn + 1) % (1 << 64))))
        while take:
            trial = of.copy()
            trial[ids[drawn[:take]]] = best[drawn[:take]]
            moved = _table(pairs, numbers, trial, classes)
            if likelihood(moved) > value:
                of, table, value = trial, moved, likelihood(moved)
                break
            take = take // 4 or int(take > 1)
        share = min(4 * max(take, 1) / max(len(ids), 1), 1.0)
        low = 0 if value - before > SETTLED * (value - none) else low + 1
        if low == 2 or value == before:
            return of, table
