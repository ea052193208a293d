import math
import random
import zlib
from collections import Counter

import numpy as np
from tests.llm.conftest import ODD, words

from glyphloom.llm import brown


def fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        if fold(doc) != 1:
            counts.update((text or "").encode().lower().split())
            counts[None] += 1
    total, kinds = sum(counts.values()), len(counts)
    room = math.log10(total + 0.5 * (kinds + 1))
    out = []
    for doc, text in rows:
        tokens = (text or "").encode().lower().split() + [None]
        out.append((doc, fold(doc) == 1, len(tokens), sum(t in counts for t in tokens), total,
                    round(sum(math.log10(counts[t] + 0.5) - room for t in tokens), 6)))
    return sorted(out, key=repr)


def corpus():
    """Two languages: the class before tells the class after."""
    one, two = words(1, 300).split(), [w.replace("a", "ü") + "q" for w in words(2, 300).split()]
    draw = random.Random(4)
    return ODD + [(100 + n, " ".join(draw.choices(one if n % 2 else two, k=80))) for n in range(120)]


def test_base_score_and_gain(frame):
    rows = corpus()
    for kept in (10, 150_000):
        found = brown.score_texts(frame(rows), head=50, endings=20, kept=kept, classes=12).collect()
        assert sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                        round(r.base_score, 6)) for r in found), key=repr) == plain(rows)
        held = [r for r in found if r.held_out and r.n_tokens > 50 and r.id > 99]
        assert held and all(r.score > r.base_score for r in held)


def test_score_is_a_probability(frame):
    """Over all next words, known ones and one unseen per class, the model sums to one."""
    rows = corpus()
    from pyspark.sql import functions as F

    model, counts = brown.train(frame(rows).select(F.col("text")), head=40, endings=15, classes=9)
    of = model.class_of
    table = [(of[model.symbols.of(bytes(r.word))], r.n) for r in counts.collect()]
    table.append((of[model.symbols.end], len(rows)))
    mass = np.zeros(len(model.room))
    for group, n in table:
        mass[group] += n + 0.5
    mass = (mass + 0.5) / 10 ** model.room
    assert np.allclose(mass, 1)
    assert np.allclose((10 ** model.step).sum(1), 1)
    assert model.n == sum(n for _, n in table) and model.v == len(table)


def test_exchange_reaches_a_local_optimum():
    draw = np.random.default_rng(3)
    pairs = draw.integers(0, 20, (14, 14)).astype(float)
    of = brown.exchange(pairs, 3, 50)

    def value(of):
        member = np.eye(4)[of]
        table = member.T @ pairs @ member
        return (brown._f(table).sum() - brown._f(table.sum(0)).sum() - brown._f(table.sum(1)).sum())

    for w in range(13):
        for b in range(3):
            other = of.copy()
            other[w] = b
            assert value(other) <= value(of) + 1e-6


def test_empty_table(frame):
    assert brown.score_texts(frame([])).collect() == []
