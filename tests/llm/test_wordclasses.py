import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, words
from tests.llm.test_brown import fold

from glyphloom.llm import brown, wordclasses


def likely(pairs, of, classes):
    member = np.eye(classes + 1)[of]
    return wordclasses.likelihood(member.T @ pairs @ member)


def test_propose_is_the_best_move():
    draw = np.random.default_rng(5)
    classes, size = 4, 15
    pairs = draw.poisson(1.5, (size, size)) * draw.integers(0, 60, (size, size)).astype(float)
    pairs[3] = pairs[:, 3] = 0
    for w in range(size):  # each symbol is met as often before as after others
        pairs[w, -1] += max(pairs[:, w].sum() - pairs[w].sum(), 0)
        pairs[-1, w] += max(pairs[w].sum() - pairs[:, w].sum(), 0)
    of = np.append(draw.integers(0, classes, size - 1), classes)
    member = np.eye(classes + 1)[of]
    own = np.diag(pairs)
    right, left = pairs @ member, pairs.T @ member
    right[np.arange(size), of] -= own
    left[np.arange(size), of] -= own
    best, gain = wordclasses.propose(right, left, own, of, member.T @ pairs @ member)
    for w in range(size - 1):
        values = []
        for c in range(classes):
            other = of.copy()
            other[w] = c
            values.append(likely(pairs, other, classes) - likely(pairs, of, classes))
        assert gain[w] == pytest.approx(max(values), abs=1e-6)
        assert gain[w] < 1e-9 or values[best[w]] == pytest.approx(max(values), abs=1e-6)
    assert gain[-1] == 0


def test_rare_words_have_the_class_of_their_neighbours(frame):
    """Words outside the head that end alike are told apart by what stands beside them."""
    draw = random.Random(3)
    sides = [["".join(draw.choices("bdfgk", k=6)) + "en" for _ in range(60)] for _ in range(2)]
    texts = [" ".join(x for _ in range(40) for x in (near, draw.choice(sides[n])))
             for n in (0, 1) for near in ("red", "blue")[n:n + 1] for _ in range(12)]
    docs = frame(list(enumerate(texts))).select("text")
    model, counts = brown.train(docs, head=2, endings=5, classes=4)
    ranks = {bytes(r.word).decode(): r.rank for r in counts.collect()}
    found = [{int(model.class_of[ranks[w]]) for w in side if ranks.get(w) is not None} for side in sides]
    assert all(found) and not found[0] & found[1]


def test_scores_follow_all_neighbours(frame):
    """Classes count every pair of words, and scores read every pair, also of words that do not
    travel with the tasks and stand side by side."""
    draw = random.Random(8)
    some = words(3, 200).split()
    rows = ODD + [(100 + n, " ".join(draw.choices(some, k=60)) + f" new{n} new{n + 1} once{n}")
                  for n in range(60)]
    settings = {"head": 5, "endings": 6, "kept": 10, "classes": 7}
    learn = [t for d, t in rows if fold(d) != 1]
    model, counts = brown.train(frame([(1, t) for t in learn]).select(F.col("text")), **settings)
    seen = {bytes(r.word): (r.n, r.rank) for r in counts.collect()}

    def classes(text):
        symbols = [seen[w][1] if seen.get(w, (0, None))[1] is not None else model.symbols.ending(w)
                   for w in brown.words_of((text or "").encode())]
        return [int(model.class_of[s]) for s in [*symbols, model.symbols.end]]

    end = int(model.class_of[model.symbols.end])
    pairs, total = Counter(), Counter()
    for text in learn:
        line = [end, *classes(text)]
        pairs.update(zip(line, line[1:]))
        total.update(line[1:])
    size = len(model.room)
    share = np.array([total[c] + brown.ADD for c in range(size)])
    share /= share.sum()
    step = np.array([[(pairs[a, b] + 5.0 * share[b]) / (sum(pairs[a, c] for c in range(size)) + 5.0)
                      for b in range(size)] for a in range(size)])
    assert np.allclose(model.step, np.log10(step))

    def score(text):
        line = [end, *classes(text)]
        n = [seen.get(w, (0,))[0] for w in brown.words_of((text or "").encode())] + [len(learn)]
        return sum(np.log10(x + brown.ADD) for x in n) + sum(
            model.step[a, b] - model.room[b] for a, b in zip(line, line[1:]))

    found = brown.score_texts(frame(rows), **settings).collect()
    assert sorted((r.id or 0, r.n_tokens, round(r.score, 6)) for r in found) == sorted(
        (d or 0, len(classes(t)), round(score(t), 6)) for d, t in rows)
