"""Embedding near-duplicates by product quantisation and exact cosine rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import Forest, arrow_stage, components, group_ids, whole_groups
from glyphloom.session import checkpointed

ROUTE = ["list", "member_block", "query_block"]


@dataclass(frozen=True)
class Index:
    """Coarse centroids, residual codebooks, and what a search may not miss."""

    coarse: np.ndarray   # lists x dim
    books: np.ndarray    # subspaces x codes x width
    probes: int
    reach: float         # largest squared distance by codes that is reranked

    def split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.books), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, the largest component between 0.5 and 1: the same
    directions to the last bit, and no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def nearest(x: np.ndarray, y: np.ndarray, count: int = 1, rows: int = 4096) -> np.ndarray:
    """Numbers of the ``count`` nearest rows of ``y``, nearest first."""
    parts = []
    for i in range(0, len(x), rows):
        d = squared(x[i:i + rows], y)
        near = np.argpartition(d, min(count, len(y)) - 1, 1)[:, :count]
        parts.append(np.take_along_axis(near, np.argsort(
            np.take_along_axis(d, near, 1), 1, kind="stable"), 1))
    return np.concatenate(parts) if parts else np.empty((0, min(count, len(y))), np.int64)


def kmeans(x: np.ndarray, count: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[draw.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centers)[:, 0]
        sizes = np.bincount(of, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        full = sizes > 0
        centers[full] = sums[full] / sizes[full, None]
    return centers


def encode(index: Index, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """One byte per subspace: the nearest codeword of the residual."""
    residual = index.split(x - index.coarse[lists])
    return np.stack([nearest(residual[:, j], index.books[j])[:, 0]
                     for j in range(len(index.books))], 1).astype(np.uint8)


def code_distances(index: Index, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
    """Asymmetric squared distances of queries to the coded members of one list: a table of
    distances to the codewords per query, then one look-up per subspace and member."""
    residual = index.split(queries - index.coarse[number])
    total = np.zeros((len(queries), len(codes)))
    for j, book in enumerate(index.books):
        total += squared(residual[:, j], book)[:, codes[:, j]]
    return total


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, the same whichever side comes first."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def train(sample: np.ndarray, rows: int, cosine: float, list_rows: int = 200,
          recall: float = 0.995, seed: int = 5) -> Index:
    """Fit the index on a sample of a table of ``rows`` vectors.

    A list has about ``list_rows`` members; from 1,024 lists on their number grows with the
    square root of ``rows``, and so do the members of a list.
    Probes and reach are the least that find ``recall`` of pairs made by turning sample
    vectors until their cosine is just ``cosine``, and of the sample's true pairs, with a
    margin of half as many probes again.
    """
    draw = np.random.default_rng(seed)
    x = unit(sample.astype(np.float64))
    dim = x.shape[1]
    lists = int(np.clip(rows // list_rows, 1, min(max(1024, 2 * math.isqrt(rows)), len(x))))
    coarse = kmeans(x, lists, draw)
    of = nearest(x, coarse)[:, 0]
    subspaces = max(s for s in (1, 2, 4, 8) if dim % s == 0)
    residual = (x - coarse[of]).reshape(len(x), subspaces, -1)
    count = min(256, len(x))
    books = np.stack([kmeans(residual[:, j], count, draw, 6) for j in range(subspaces)])
    bound = 2 - 2 * cosine
    index = Index(coarse, books, min(8, lists), bound)

    def missed(left: np.ndarray, right: np.ndarray, home: np.ndarray):
        """How far down each left row's lists the right row's is, and its code's distance."""
        hit = nearest(left, coarse, min(64, lists)) == home[:, None]
        table = (left - coarse[home]).reshape(len(left), subspaces, -1)
        coded = books[np.arange(subspaces), encode(index, right, home)]
        return (np.where(hit.any(1), hit.argmax(1), hit.shape[1]),
                ((table - coded) ** 2).sum((1, 2)))

    queries = draw.choice(len(x), min(2000, len(x)), replace=False)
    noise = draw.standard_normal((len(queries), dim))
    noise -= (noise * x[queries]).sum(1, keepdims=True) * x[queries]
    shifted = cosine * x[queries] + np.sqrt(1 - cosine ** 2) * unit(noise + 1e-12)
    found = [missed(x[queries], shifted, nearest(shifted, coarse)[:, 0])]
    for q in np.array_split(queries, max(1, len(queries) // 256)):
        left, right = np.nonzero(x[q] @ x.T >= cosine)
        left = q[left]
        left, right = left[left != right][:50_000], right[left != right][:50_000]
        if len(left):
            found.append(missed(x[left], x[right], of[right]))
    depth = max(np.quantile(np.concatenate(part), recall, method="higher") for part in
                ([r for r, _ in found[:1]], [r for r, _ in found]))
    reach = max(np.quantile(np.concatenate(part), recall, method="higher") for part in
                ([e for _, e in found[:1]], [e for _, e in found]))
    probes = int(depth) + 1
    return Index(coarse, books, min(probes + (probes + 1) // 2, lists), float(reach) * 1.1)


def _links(index: Index, number: int, cosine: float, members: dict, queries: dict, seen: Forest,
           counts: np.ndarray) -> None:
    """Add the links of one block: counts per row (members first) and a forest."""
    size = len(members["node"])
    for at in range(0, len(queries["node"]), 512):
        part = slice(at, at + 512)
        near = code_distances(index, queries["unit"][part], number, members["codes"])
        q, m = np.nonzero(near <= index.reach)
        q += at
        apart = queries["node"][q] != members["node"][m]
        q, m = q[apart], m[apart]
        close = np.concatenate([cosines(queries["x"][a], members["x"][b]) >= cosine
                                for a, b in zip(np.array_split(q, len(q) // 100_000 + 1),
                                                np.array_split(m, len(q) // 100_000 + 1))])
        q, m = q[close], m[close]
        np.add.at(counts, size + q, members["copies"][m])
        # The pair is also met the other way round if the member probes the query's list.
        once = ~(members["probes"][m] == queries["home"][q][:, None]).any(1)
        np.add.at(counts, m[once], queries["copies"][q[once]])
        seen.add(m, size + q)


def embedding_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     cosine: float = 0.9, sample_rows: int = 20_000,
                     block: int = 4096) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per input row.

    Equal vectors are one node with a number of copies, so a vector that a third of all rows
    share is one row of the search.  The index is fitted on the nodes of smallest hash,
    ``sample_rows`` or eight times the square root of all, and holds every node: coarse lists, and a residual code per node.  A node
    probes its nearest lists; candidates by code distance are reranked by exact cosine.  A
    list longer than ``block`` is dealt out as pairs of blocks of members and queries over
    several tasks.  Blocks return counts and spanning forests, never their pairs.

    Vectors that are null, zero, hold null or non-finite components, or have another length
    than most, link with nothing; very small and very large ones link like any other.  Null ids keep their rows and count as links, but name no
    component.  Repeated rows are vectors of their own; an empty table gives an empty result.
    """
    spark = table.sparkSession
    source = table.select(F.col(id_col).cast("bigint").alias("id"),
                          F.col(vector_col).cast("array<double>").alias("x"))
    sizes = source.where("x IS NOT NULL").groupBy(F.size("x").alias("n")).count().orderBy(
        F.desc("count"), "n").first()
    dim = sizes.n if sizes else 0
    sound = (F.size("x") == dim) & F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) \
        & F.exists("x", lambda v: v != 0)
    hashed = source.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.lit(dim > 0)).withColumns({
        "h1": F.xxhash64("x"), "h2": F.xxhash64("x", F.lit("second"))})
    nodes = checkpointed(hashed.where("sound").groupBy("h1", "h2").agg(
        F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.count()
    ids = hashed.select("id", "sound", "h1", "h2")
    if not rows:
        return ids.select("id", F.lit(0).cast("bigint").alias("n_links"),
                          F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    sample = nodes.orderBy("h1", "h2").limit(max(sample_rows, 8 * math.isqrt(rows))).select(
        "x").collect()
    index = train(np.array([r.x for r in sample]), rows, cosine)

    def place(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy()).reshape(batch.num_rows, -1)
            normed = unit(x)
            probes = nearest(normed, index.coarse, index.probes)
            codes = encode(index, normed, probes[:, 0])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(probes[:, 0]),
                 pa.array(list(probes), pa.list_(pa.int64())),
                 pa.array([c.tobytes() for c in codes], pa.binary())],
                ["node", "x", "copies", "home", "probes", "codes"])

    placed = checkpointed(arrow_stage(
        nodes.select("node", "x", "copies"), place,
        "node bigint, x array<double>, copies bigint, home bigint, probes array<bigint>, "
        "codes binary"))
    queries = placed.withColumn("list", F.explode("probes"))
    lengths = {r.list: (r.members, r.queries) for r in queries.groupBy("list").agg(
        F.count_if(F.col("home") == F.col("list")).alias("members"),
        F.count(F.lit(1)).alias("queries")).collect()}  # at most one row per list
    grid = spark.createDataFrame(
        [(k, -(-m // block), -(-q // (4 * block))) for k, (m, q) in lengths.items() if m],
        "list bigint, g_m int, g_q int")
    own = F.xxhash64("node", F.lit("block"))
    fields = ["node", "x", "copies", "home", "probes", "codes"]
    members = placed.withColumn("list", F.col("home")).join(F.broadcast(grid), "list").select(
        *fields, "list", F.pmod(own, "g_m").cast("int").alias("member_block"),
        F.explode(F.sequence(F.lit(0), F.col("g_q") - 1)).alias("query_block"),
        F.lit(0).alias("role"))
    asking = queries.join(F.broadcast(grid), "list").select(
        *fields, "list", F.explode(F.sequence(F.lit(0), F.col("g_m") - 1)).alias("member_block"),
        F.pmod(own, "g_q").cast("int").alias("query_block"), F.lit(1).alias("role"))

    def side(part: pa.Table) -> dict:
        x = part["x"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        return {"node": part["node"].to_numpy(), "x": x, "unit": unit(x),
                "copies": part["copies"].to_numpy(), "home": part["home"].to_numpy(),
                "probes": part["probes"].combine_chunks().flatten().to_numpy().reshape(
                    part.num_rows, -1),
                "codes": np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(
                    part.num_rows, -1)}

    def search(batches):
        for joined in whole_groups(batches, ROUTE, 20_000):
            cuts = np.flatnonzero(np.diff(group_ids(joined, ROUTE), prepend=-1))
            for at, size in zip(cuts.tolist(), np.diff(np.append(cuts, joined.num_rows)).tolist()):
                group = joined.slice(at, size)
                count = int((group["role"].to_numpy() == 0).sum())
                if not 0 < count < size:
                    continue
                known, asked = side(group.slice(0, count)), side(group.slice(count))
                forest, counts = Forest(size), np.zeros(size, np.int64)
                _links(index, group["list"][0].as_py(), cosine, known, asked, forest, counts)
                node = np.concatenate([known["node"], asked["node"]])
                linked = np.flatnonzero(counts)
                ends = np.array(forest.links, np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [pa.array(np.concatenate([node[linked], node[ends[:, 0]]])),
                     pa.array(np.concatenate([node[linked], node[ends[:, 1]]])),
                     pa.array(np.concatenate([counts[linked], np.zeros(len(ends), np.int64)]))],
                    ["a", "b", "n"])

    dealt = members.unionByName(asking).repartition(*ROUTE).sortWithinPartitions(*ROUTE, "role")
    found = checkpointed(arrow_stage(dealt, search, "a bigint, b bigint, n bigint"))
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    groups = components(found.where("n = 0").select("a", "b"))
    known = nodes.select("node", "h1", "h2", "copies").join(links, "node", "left").join(
        groups, "node", "left").select(
        "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("label", "node").alias("label"))
    joined = checkpointed(ids.where("sound").join(known, ["h1", "h2"]).select("id", "n_links", "label"))
    first = joined.groupBy("label").agg(F.min("id").alias("component_id"))
    alone = ids.where("NOT sound").select("id", F.lit(0).cast("bigint").alias("n_links"),
                                          F.col("id").alias("component_id"))
    return joined.join(first, "label").select("id", "n_links", "component_id").unionAll(
        alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
