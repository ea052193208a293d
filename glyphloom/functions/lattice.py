"""Segmentation lattices of many units at once: a shared automaton and array recurrences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_CODE_BITS = 21  # a code point
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1e250     # sums of products beyond this, or below its inverse, are redone in logarithms


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each begins (one more at the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


@dataclass(frozen=True)
class Automaton:
    """A trie of pieces as one hash table of transitions ``(state, code point) -> state``.

    Built and searched in whole arrays.  A task needs about 50 bytes a piece.
    """

    keys: np.ndarray      # transition, -1 where the slot is free
    targets: np.ndarray   # state after it
    pieces: np.ndarray    # by state: number of the piece that ends here, or -1
    longest: int

    @classmethod
    def of(cls, texts: list[str]) -> Automaton:
        codes, starts = spelled(texts)
        sizes = np.diff(starts)
        state = np.zeros(len(texts), np.int64)
        keys, states = [], 1
        for depth in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > depth)
            found, of = np.unique(state[live] << _CODE_BITS | codes[starts[live] + depth],
                                  return_inverse=True)
            state[live] = states + of
            keys.append(found)
            states += len(found)
        pieces = np.full(states, -1, np.int32)
        pieces[state[sizes > 0]] = np.flatnonzero(sizes > 0)
        return cls(*_table(np.concatenate(keys) if keys else np.empty(0, np.int64)), pieces,
                   int(sizes.max(initial=0)))

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        wanted = state << _CODE_BITS | codes
        place = _home(wanted, len(self.keys))
        found = self.keys[place]
        wrong = np.flatnonzero((found != wanted) & (found >= 0))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) % len(self.keys)
            found[wrong] = self.keys[place[wrong]]
            wrong = wrong[(found[wrong] != wanted[wrong]) & (found[wrong] >= 0)]
        return np.where(found == wanted, self.targets[place], -1).astype(np.int64)

    def lattice(self, texts: list[str]) -> Lattice:
        codes, starts = spelled(texts)
        unit = np.repeat(np.arange(len(texts)), np.diff(starts))
        room = starts[1:][unit] - np.arange(len(codes))
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        begins, sizes, pieces = [], [], []
        for depth in range(self.longest):
            inside = room[at] > depth
            at, state = at[inside], state[inside]
            state = self.step(state, codes[at + depth])
            on = state >= 0
            at, state = at[on], state[on]
            piece = self.pieces[state]
            ends = piece >= 0
            begins.append(at[ends])
            sizes.append(np.full(int(ends.sum()), depth + 1))
            pieces.append(piece[ends])
        place = np.concatenate([*begins, np.empty(0, np.int64)])
        size = np.concatenate([*sizes, np.empty(0, np.int64)])
        of = unit[place]
        return Lattice(starts + np.arange(len(texts) + 1), place + of, place + of + size,
                       np.concatenate([*pieces, np.empty(0, np.int32)]), place - starts[of], size)


def _narrow(values: np.ndarray, top: int) -> np.ndarray:
    """``values`` of 0 to ``top`` in 16 bits where they fit: such columns are sorted by digits."""
    return values.astype(np.uint16) if top < 1 << 16 else values


def _home(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys.astype(np.uint64) * _ODD >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots = 1 << max(int(2 * len(keys)).bit_length(), 4)
    held, targets = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
    left, place = np.arange(len(keys)), _home(keys, slots)
    while len(left):
        free = held[place] < 0
        held[place[free]] = keys[left[free]]  # of those that meet, one stays
        lost = held[place] != keys[left]
        targets[place[~lost]] = left[~lost] + 1
        left, place = left[lost], (place[lost] + 1) % slots
    return held, targets


@dataclass(frozen=True)
class Lattice:
    """All pieces at all places of some units.

    A unit of ``n`` characters has ``n + 1`` nodes, the first at ``first[unit]``; an edge
    leads from ``start`` to ``end`` over a piece, ``offset`` characters into its unit.
    """

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    offset: np.ndarray
    size: np.ndarray

    def without(self, gone: np.ndarray) -> Lattice:
        keep = ~gone
        return Lattice(self.first, *(c[keep] for c in (
            self.start, self.end, self.piece, self.offset, self.size)))

    def whole(self) -> np.ndarray:
        """The edges that span their unit."""
        unit = np.searchsorted(self.first, self.start, side="right") - 1
        return (self.start == self.first[unit]) & (self.end == self.first[unit + 1] - 1)

    def _slices(self, by: np.ndarray):
        """Edges in groups of rising ``by``."""
        top = int(by.max(initial=-1))
        order = np.argsort(_narrow(by, top), kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(by, minlength=top + 1)))
        return [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def expected(self, scores: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        """Add to ``into`` the uses of each piece expected over all segmentations, each unit
        weighted: one pass forward, one backward, all units together.

        Products are scaled by a constant a character; units that leave the range of doubles
        all the same are redone in logarithms.
        """
        if not len(self.start):
            return
        # Dead pieces have score -inf and so probability 0.
        usual = -float(np.mean(np.maximum(scores[self.piece], -50.0) / self.size))
        prob = np.exp(scores[self.piece] + usual * self.size)
        steps = self._slices(self.offset)
        ahead = np.zeros(self.first[-1])
        ahead[self.first[:-1]] = 1.0
        last = self.first[1:] - 1
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            for edges in steps:
                np.add.at(ahead, self.end[edges], ahead[self.start[edges]] * prob[edges])
            good = (ahead[last] > 1 / _FAR) & (ahead[last] < _FAR)
            behind = np.zeros(self.first[-1])
            behind[last[good]] = weights[good] / ahead[last[good]]
            for edges in reversed(steps):
                np.add.at(behind, self.start[edges], behind[self.end[edges]] * prob[edges])
            share = ahead[self.start] * behind[self.end] * prob
        if good.all():
            np.add.at(into, self.piece, share)
            return
        unit = np.searchsorted(self.first, self.start, side="right") - 1
        fine = good[unit]
        np.add.at(into, self.piece[fine], share[fine])
        rest = self.without(fine)
        rest._expected_log(scores, np.where(good, 0.0, weights), into)

    def _expected_log(self, scores: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        cost, steps = scores[self.piece], self._slices(self.offset)
        ahead, behind = (np.full(self.first[-1], -np.inf) for _ in range(2))
        last = self.first[1:] - 1
        ahead[self.first[:-1]] = behind[last] = 0.0
        for edges in steps:
            np.logaddexp.at(ahead, self.end[edges], ahead[self.start[edges]] + cost[edges])
        for edges in reversed(steps):
            np.logaddexp.at(behind, self.start[edges], behind[self.end[edges]] + cost[edges])
        unit = np.searchsorted(self.first, self.start, side="right") - 1
        total = ahead[last][unit]
        with np.errstate(invalid="ignore"):
            share = weights[unit] * np.exp(ahead[self.start] + cost + behind[self.end] - total)
        np.add.at(into, self.piece, np.where(np.isfinite(total), share, 0.0))

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of the best path to each node, and the edge that ends it there (-1: none).

        Of equal paths the one whose last piece starts first stays.
        """
        total = np.full(self.first[-1], -np.inf)
        total[self.first[:-1]] = 0.0
        back = np.full(self.first[-1], -1)
        stop = self.offset + self.size
        top = int(stop.max(initial=0))
        ranked = np.lexsort((self.start, self.end, _narrow(stop, top)))
        cuts = np.append(0, np.cumsum(np.bincount(stop, minlength=top + 1)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            edges = ranked[a:b]
            ends, value = self.end[edges], total[self.start[edges]] + scores[self.piece[edges]]
            heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            most = np.maximum.reduceat(value, heads)
            group = np.cumsum(np.append(False, ends[1:] != ends[:-1]))
            equal = np.flatnonzero((value == most[group]) & (most[group] > -np.inf))
            node, first = np.unique(ends[equal], return_index=True)
            total[node], back[node] = value[equal[first]], edges[equal[first]]
        return total, back

    def used(self, scores: np.ndarray, weights: np.ndarray, into: np.ndarray) -> None:
        """Add to ``into`` the pieces on the best path of each unit, weighted."""
        _, back = self.best(scores)
        node, weights = self.first[1:] - 1, weights.copy()
        while len(node):
            edge = back[node]
            on = edge >= 0  # the first node, or a unit that the pieces do not cover
            edge, weights = edge[on], weights[on]
            np.add.at(into, self.piece[edge], weights)
            node = self.start[edge]
