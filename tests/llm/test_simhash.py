import random

import numpy as np
import pandas as pd
from tests.llm.conftest import ODD, words
from xxhash import xxh64_intdigest

from glyphloom.llm import simhash
from glyphloom.llm.common import Forest, components


def slow_print(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, distance=3):
    prints = [slow_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, prints[i], least.get(root(i))) for i, (doc, _) in enumerate(rows)),
                  key=repr)


def got(df):
    return sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=repr)


def test_groups_equal_brute_force(frame):
    draw = random.Random(3)
    rows = list(ODD)
    for n in range(60):
        base = words(100 + n % 12, 150).split()
        for _ in range(draw.randint(0, 3)):
            base[draw.randrange(len(base))] = "changed"
        rows.append((100 + n, " ".join(base)))
    assert got(simhash.simhash_groups(frame(rows))) == slow_groups(rows)


def test_empty_table(frame):
    assert simhash.simhash_groups(frame([])).collect() == []


def test_links_with_split_buckets(spark):
    """Dense buckets dealt out as block pairs link as whole ones do."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 64, 3, np.uint64)
    prints = np.unique(np.concatenate([
        [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))
         for i, j in draw.integers(0, 64, (40, 2))] for b in base]).astype(np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)}))
    for block in (7, 4096):
        links = simhash.near_links(df, block=block)
        found = {r.node: r.label for r in components(links).collect()}
        labels = [found.get(int(p), int(p)) for p in prints.view(np.int64)]
        for i in range(len(prints)):
            for j in range(i):
                if int(prints[i] ^ prints[j]).bit_count() <= 3:
                    assert labels[i] == labels[j]
        assert all((int(a.a) ^ int(a.b)) % (1 << 64) and
                   ((a.a ^ a.b) % (1 << 64)).bit_count() <= 3 for a in links.collect())


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(None, 1), (7, 7)]
    edges += [(i, i + 1) for i in range(200, 260)]
    want = Forest(300)
    pairs = np.array([e for e in edges if None not in e])
    want.add(pairs[:, 0], pairs[:, 1])
    found = {r.node: r.label for r in components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    touched = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert found == {x: want.root(x) for x in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
