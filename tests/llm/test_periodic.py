import hashlib
import random
import zlib

import numpy as np
import pytest

from glyphloom.llm import periodic, queries
from tests.llm.conftest import ODD, words


def plain(x, least=6, times=4):
    """Every period by itself: longest stretches of words that repeat q words later."""
    runs, n = [], len(x)
    for q in range(1, n // times + 1):
        at = 0
        while at < n - q:
            end = at
            while end + q < n and x[end] == x[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(least, times * q) and not any(
                    all(x[i] == x[i + s] for i in range(at, at + length - s)) for s in range(1, q)):
                runs.append((at, length, q))
            at = max(end, at + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    """What the query returns, by the wording of its contract."""
    x = [w for w in (text or "").encode().replace(b"\v", b" ").replace(b"\f", b" ").split()]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0, len(x)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    runs = plain(x)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(x) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts():
    draw = random.Random(7)
    out = []
    for n in range(120):
        parts = []
        for _ in range(draw.randint(1, 6)):
            unit = words(n + 31 * len(parts), draw.randint(1, 6)).split()
            parts += unit * draw.choice([1, 1, 2, 4, 5, 9]) + unit[:draw.randint(0, 3)]
        out.append((n * 7, draw.choice([" ", "\n", " \t"]).join(parts)))
    out += [(1000 + n, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))) for n in range(120)]
    return out + [(5000, "a " * 400), (5001, "a b " * 200 + "a a b " * 100), (5002, "x y " * 9)]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    draw = np.random.default_rng(letters)
    for n in [0, 1, 5, 6, 7, *draw.integers(8, 70, 150).tolist()]:
        x = draw.integers(0, letters, n)
        if n > 36:
            at, q = draw.integers(0, 10), draw.integers(1, 8)
            x[at:at + 26] = np.resize(x[at:at + q], 26)
        assert periodic.periodic_runs(x) == plain(x.tolist())
        assert periodic.periodic_runs(x, 4, 2) == plain(x.tolist(), 4, 2)


def test_suffixes_are_sorted():
    x = np.random.default_rng(5).integers(0, 2, 300)
    order, common = periodic.suffix_order(x)
    want = sorted(range(300), key=lambda i: x[i:].tolist())
    assert order.tolist() == want
    for a, b, got in zip(want, want[1:], common.tolist()):
        y = [p == q for p, q in zip(x[a:], x[b:])]
        assert got == (y.index(False) if False in y else len(y))


def test_query_equals_brute_force(spark, frame, monkeypatch):
    rows = texts() + [r for r in ODD if r[1] is None or len(r[1]) < 9000]
    monkeypatch.setattr(queries, "table", lambda *_: frame(rows))
    monkeypatch.setattr(periodic, "HELD", 3000)
    monkeypatch.setattr(periodic, "WRITTEN", 2000)
    got = queries.op13_descending_lcp(spark, "")
    want = [row(*r) for r in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 100 and "Exchange" not in \
        got.select("doc_id").limit(0)._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_and_empty_table(frame):
    tail = words(2, 30000).split()
    rows = [(1, " ".join(tail[:20000] * 4)), (2, "z " * 60000), (3, " ".join(tail))]
    found = {r.id: r for r in periodic.find_runs(frame(rows, clash=True)).collect()}
    assert [tuple(r) for r in found[1].runs if r.period == 20000] == [(0, 80000, 20000)]
    assert [tuple(r) for r in found[2].runs] == [(0, 60000, 1)] and found[2].collapsed == "z"
    assert found[3].n_words == 30000
    assert periodic.find_runs(frame([])).collect() == []
