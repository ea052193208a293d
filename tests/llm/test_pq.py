import math

import numpy as np

from glyphloom.llm import pq


def sample(spark, count=900, dim=16):
    draw = np.random.default_rng(1)
    centers = draw.standard_normal((40, dim))
    x = centers[draw.integers(0, 40, count)] + draw.standard_normal((count, dim)) * 0.25
    x[:150] = x[0]
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    odd = [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1),
           [float("inf")] * dim, [1.0] * (dim + 1), []]
    rows += [(5000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 0), (899, rows[899][1], 0), (6000, [2 * v for v in rows[0][1]], 0)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr(
        "*", "'n' node", "1 copies", "2 id", "3 h1")


def plain(rows, dim=16):
    good = [i for i, (_, v, _) in enumerate(rows) if v and len(v) == dim and all(
        c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    label = np.arange(len(good))
    for _ in range(200):
        label = np.array([label[n].min() for n in near])
    links, comp = {}, {}
    for k, i in enumerate(good):
        ids = [rows[good[m]][0] for m in np.flatnonzero(label == label[k])]
        comp[i] = min(d for d in ids if d is not None)
        links[i] = int(near[k].sum()) - 1
    return [(r[0], links.get(i, 0), comp.get(i, r[0])) for i, r in enumerate(rows)]


def test_links_and_components(spark):
    rows, df = sample(spark)
    want = sorted(plain(rows), key=repr)
    for block in (16, 4096):
        found = pq.embedding_groups(df, block=block).collect()
        got = sorted(((r.id, r.n_links, r.component_id) for r in found), key=repr)
        assert len(got) == len(want)
        true, seen = sum(w[1] for w in want), sum(g[1] for g in got)
        assert 0.97 * true <= seen <= true
        assert np.mean([g == w for g, w in zip(got, want)]) > 0.97
        assert all(r.kept == (r.id is not None and r.id == r.component_id) for r in found)


def test_no_sound_vector_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, pq.embedding_groups(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pq.embedding_groups(df.limit(0)).collect() == []


def test_codes_rank_true_neighbours():
    draw = np.random.default_rng(2)
    x = pq.unit(draw.standard_normal((600, 16)))
    index = pq.train(x, 600, 0.9)
    lists = pq.nearest(x, index.coarse)[:, 0]
    for number in range(len(index.coarse)):
        rows = np.flatnonzero(lists == number)
        if len(rows):
            codes = pq.encode(index, x[rows], lists[rows])
            got = pq.code_distances(index, x[:50], number, codes)
            coded = index.coarse[number] + np.concatenate(
                [index.books[j][codes[:, j]] for j in range(len(index.books))], 1)
            assert np.allclose(got, pq.squared(x[:50], coded))


def test_tiny_and_huge_vectors_link_like_any_other(spark):
    rows, _ = sample(spark)
    dim = 16
    rows += [(7000, [1e-200] * dim, 0), (7001, [3e-310] * dim, 0), (7002, [1e300] * dim, 0),
             (7003, [v * 1e-250 for v in rows[0][1]], 0), (7004, [v * 1e300 for v in rows[1][1]], 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id bigint, embedding array<double>")
    found = {r.id: (r.n_links, r.component_id) for r in pq.embedding_groups(df).collect()}
    assert found[7000] == found[7001] == found[7002] == (2, 7000)
    links = {0: found[0], 1: found[1]}
    assert found[7003] == links[0] and found[7004] == links[1] and links[0][0] > 100


def test_scaling_changes_no_bit():
    draw = np.random.default_rng(4)
    x, y = draw.standard_normal((2, 500, 24)) * 10.0 ** draw.integers(-9, 9, (2, 500, 1))
    assert np.array_equal(pq.cosines(x, y), (x * y).sum(1) / (
        np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))))


def test_lists_grow_with_the_table():
    x = np.random.default_rng(3).standard_normal((3000, 8))
    assert len(pq.train(x, 400_000, 0.9).coarse) > len(pq.train(x, 200_000, 0.9).coarse) == 1000
