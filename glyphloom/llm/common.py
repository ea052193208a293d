"""Helpers shared by the operators: scans, Arrow stages, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphloom.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: the fold of a document (null id: fold of '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that tell rows apart by id and text; never null, equal rows share it."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
             for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit(" "), parts[1])))


def arrow_stage(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]],
                                             Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``df`` through one Arrow function per task, no shuffle."""
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its last column, a string, compressed as binary (null as empty), so that a
    join moves about a third of the texts."""
    from pyspark.sql import types as T

    *others, last = df.schema
    schema = T.StructType([*others, T.StructField(last.name, T.BinaryType())])
    names = schema.names

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([pack(t) for t in as_bytes(batch.columns[-1])], pa.binary())
            yield pa.record_batch([*batch.columns[:-1], texts], names)

    return arrow_stage(df, run, schema)


def unsqueezed(column: pa.Array) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in column.to_pylist()]


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of ``(a, b)`` as ``(node, label)``, label the smallest node.

    Alternates large-star and small-star steps, each one aggregate and one join on the
    edges; the edge list is checkpointed after every round and ends as stars.  Only nodes
    that some edge touches are returned; an empty edge list gives an empty result.  Null
    ends and self links are ignored.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = checkpointed(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                         .select(hi, lo).distinct())
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(parent, "hi").where("lo <> m").select(
            F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = checkpointed(moved.unionAll(parent.select("hi", F.col("m").alias("lo")))
                             .distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(
        roots.select("node", F.col("node").alias("label")))


def blocked_groups(df: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Rows of the groups with two or more members, large groups dealt out as block pairs.

    A group of ``n`` rows has ``g = ceil(n / block)`` parts by the hash of ``member``, and
    a row goes to each of the ``g`` pairs that hold its part: every two rows of a group meet
    in some ``(keys, part_i, part_j)``, none of which holds more than about two blocks.
    The result is partitioned and sorted by them.
    """
    from pyspark.sql import Window

    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    parts = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    dealt = (counted.where("_n > 1")
             .withColumn("_g", parts)
             .withColumn("_p", F.pmod(F.xxhash64(member, F.lit("part")), F.col("_g")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
             .withColumn("part_i", F.least("_p", "_o"))
             .withColumn("part_j", F.greatest("_p", "_o"))
             .drop("_n", "_g", "_p", "_o"))
    order = [*keys, "part_i", "part_j"]
    return dealt.repartition(*order).sortWithinPartitions(*order)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str],
                 rows: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of about ``rows`` rows that never split a group.

    A group longer than that is held whole; callers bound it before.
    """
    import numpy as np

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows:
            continue
        joined = pa.concat_tables(held).combine_chunks()
        new = np.zeros(joined.num_rows, bool)
        for key in keys:
            column = joined[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        cuts = np.flatnonzero(new)
        cut = int(cuts[-1]) if len(cuts) else 0
        if cut:
            yield joined.slice(0, cut)
        held, size = [joined.slice(cut)], joined.num_rows - cut
    if size:
        yield pa.concat_tables(held).combine_chunks()


def group_ids(joined: pa.Table, keys: list[str]):
    """A dense group number for each row of a sorted table."""
    import numpy as np

    new = np.zeros(joined.num_rows, bool)
    for key in keys:
        column = joined[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


class Forest:
    """Union-find over rows 0..n-1 that keeps one link for each union."""

    def __init__(self, n: int):
        import numpy as np

        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def add(self, left, right) -> None:
        """Unite pairs given as two index arrays."""
        import numpy as np

        while True:
            flat = self.parent[self.parent]
            if np.array_equal(flat, self.parent):
                break
            self.parent = flat
        open_ = self.parent[left] != self.parent[right]
        for a, b in zip(left[open_].tolist(), right[open_].tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))
