"""Segmentation of one short unit; small helpers for Arrow-batched tasks."""

from __future__ import annotations

import heapq
import math


def merge_unit(unit: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of ``unit`` after merging, always the pair of lowest rank, leftmost first.

    Waiting pairs sit in a heap, so a long unit costs little more than its length.
    """
    parts: list[str | None] = list(unit)
    n = len(parts)
    waiting = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
    if not waiting:
        return parts
    heapq.heapify(waiting)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    while waiting:
        rank, i = heapq.heappop(waiting)
        j = right[i]
        # Skip pairs that an earlier merge has changed.
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i] += parts[j]
        parts[j] = None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            follow = ranks.get((parts[i], parts[k]))
            if follow is not None:
                heapq.heappush(waiting, (follow, i))
        h = left[i]
        if h >= 0:
            before = ranks.get((parts[h], parts[i]))
            if before is not None:
                heapq.heappush(waiting, (before, h))
    return [p for p in parts if p is not None]


def merge_in_order(unit: list[int], rules: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after the rules ``pair -> (rank, symbol)``, each applied once, by rank.

    A pair that a rule makes is merged by later rules only, as in training.
    """
    parts: list[int | None] = list(unit)
    n = len(parts)
    waiting = [(rules[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rules]
    heapq.heapify(waiting)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    while waiting:
        rank, i = heapq.heappop(waiting)
        j = right[i]
        if parts[i] is None or j >= n or rules.get((parts[i], parts[j]), (-1,))[0] != rank:
            continue
        parts[i], parts[j] = rules[parts[i], parts[j]][1], None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
        for a, b in ((left[i], i), (i, k)):
            if a >= 0 and b < n:
                later = rules.get((parts[a], parts[b]))
                if later and later[0] > rank:
                    heapq.heappush(waiting, (later[0], a))
    return [p for p in parts if p is not None]


def with_prefixes(scores: dict[str, float]) -> dict[str, float | None]:
    """The scores, plus every proper prefix of a piece with None: a search may stop at
    the first text that is neither."""
    known: dict[str, float | None] = {}
    for piece in scores:
        for end in range(len(piece) - 1, 0, -1):
            if piece[:end] in known:
                break
            known[piece[:end]] = None
    known.update(scores)
    return known


_END = object()


def best_path(unit: str, known: dict[str, float | None], unknown: float,
              without: str | None = None) -> tuple[list[tuple[int, int]], float]:
    """Best-scoring spans ``(start, end)`` over the pieces, and their total score.

    ``known`` comes from :func:`with_prefixes`.  Where no one-character piece starts, one
    unknown character is an option at score ``unknown``.  Among equal paths the first
    found, by start then length, stays.
    """
    n = len(unit)
    total = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    for start in range(n):
        here = total[start]
        if here == -math.inf:
            continue
        single = False
        for end in range(start + 1, n + 1):
            piece = unit[start:end]
            score = known.get(piece, _END)
            if score is _END:
                break
            if score is None or piece == without:
                continue
            single = single or end == start + 1
            if here + score > total[end]:
                total[end], back[end] = here + score, start
        if not single and here + unknown > total[start + 1]:
            total[start + 1], back[start + 1] = here + unknown, start
    spans, end = [], n
    while end > 0:
        spans.append((back[end], end))
        end = back[end]
    return spans[::-1], total[n]


def digamma(x: float) -> float:
    """Derivative of ln(gamma), for x > 0: recurrence up to 10, then the asymptotic series."""
    shift = 0.0
    while x < 10:
        shift -= 1 / x
        x += 1
    inv = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def digammas(x):
    """``digamma`` of each element of an array."""
    import numpy as np

    x, shift = x.astype(float), np.zeros(len(x))
    while (low := x < 10).any():
        shift[low] -= 1 / x[low]
        x[low] += 1
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))
