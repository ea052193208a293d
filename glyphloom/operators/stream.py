"""The token stream of a split: order, positions, windows, batches and weights.

An *encoded* corpus is ``(split, doc_id, ids)``, one array per document without special
tokens.  The stream of a split is ``prefix``, all documents in id order with ``joint``
ids between them, ``suffix``.  It is never built as one array: a *layout*, one narrow row
per document, says where each document starts.

An id may be null or repeated: null comes first, documents of one id are ordered by a hash
of their ids, and equal ones by the number that every stored row has.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from glyphloom.functions.metrics import interior_weight, target_weight
from glyphloom.functions.text import BOS, EOS, int_array, neighbours
from glyphloom.operators.narrow import parts_of_batches
from glyphloom.session import checkpointed, parallelism, written


# The order of the documents of a split; ``row`` alone tells them apart.
ORDER = ["doc_id", "mark", "row"]
HELD = 500_000  # different pairs that a task holds before it passes them on


@dataclass(frozen=True)
class Joining:
    """Ids at the start of a stream, between two documents, and at the end."""

    prefix: tuple[int, ...] = (BOS,)
    joint: tuple[int, ...] = ()
    suffix: tuple[int, ...] = (EOS,)


def store_encoded(encoded: DataFrame) -> DataFrame:
    """Write an encoded corpus once, by split, with the narrow columns the layout needs.

    ``n``, ``head`` and ``tail`` (length, first and last id) sit beside ``ids`` so that
    the layout never reads the arrays.  ``mark`` is a hash of the ids, ``row`` the row's own
    number, a stored fact from here on.  Files are sorted by id, so a bound on the id prunes
    their row groups.
    """
    wide = encoded.select(
        "split", "doc_id", F.xxhash64("ids").alias("mark"),
        F.monotonically_increasing_id().alias("row"), F.size("ids").alias("n"),
        F.get("ids", F.lit(0)).alias("head"),
        F.get("ids", F.size("ids") - 1).alias("tail"), "ids")
    return written(wide.sortWithinPartitions("split", "doc_id"), "encoded", ("split",))


def _edges(stored: DataFrame) -> DataFrame:
    """First and last document of each split: one row per split."""
    place = F.struct(F.col("doc_id").isNotNull(), *ORDER)
    return stored.groupBy("split").agg(F.min_by("row", place).alias("first_row"),
                                       F.max_by("row", place).alias("last_row"))


def _placed(stored: DataFrame) -> DataFrame:
    """``stored`` with ``is_first`` / ``is_last``; the edges are one row per split."""
    return (stored.join(F.broadcast(_edges(stored)), "split")
            .withColumn("is_first", F.col("row") == F.col("first_row"))
            .withColumn("is_last", F.col("row") == F.col("last_row"))
            .drop("first_row", "last_row"))


def _segment(joining: Joining) -> Column:
    """The ids a document adds to the stream, from ``ids`` and its place."""
    front = F.when(F.col("is_first"), int_array(*joining.prefix)).otherwise(int_array())
    back = F.when(F.col("is_last"), int_array(*joining.suffix)).otherwise(
        int_array(*joining.joint))
    return F.concat(front, F.col("ids"), back)


def _end_id(ids: tuple[int, ...], at: int) -> Column:
    return F.lit(ids[at] if ids else None).cast("int")


def layout(stored: DataFrame, joining: Joining) -> DataFrame:
    """Where each document's segment sits in its stream, one row per document.

    ``(split, *ORDER, is_first, is_last, size, seg_head, prev_tail, start, length)``:
    ``start`` is the position of the segment's first id, ``prev_tail`` the id before it.

    A prefix sum over the whole corpus without a single-task window: rows are range
    partitioned by key and checkpointed, so that the part number is a stored fact; sums
    run inside each part, and one row per part carries them across parts.
    """
    narrow = _placed(stored.select("split", *ORDER, "n", "head", "tail"))
    front = F.when(F.col("is_first"), F.lit(len(joining.prefix))).otherwise(0)
    back = F.when(F.col("is_last"), F.lit(len(joining.suffix))).otherwise(len(joining.joint))
    back_head = F.when(F.col("is_last"), _end_id(joining.suffix, 0)).otherwise(
        _end_id(joining.joint, 0))
    back_tail = F.when(F.col("is_last"), _end_id(joining.suffix, -1)).otherwise(
        _end_id(joining.joint, -1))
    front_head = F.when(F.col("is_first"), _end_id(joining.prefix, 0))
    front_tail = F.when(F.col("is_first"), _end_id(joining.prefix, -1))
    sized = narrow.select(
        "split", *ORDER, "is_first", "is_last",
        (F.col("n") + front + back).cast("bigint").alias("size"),
        F.coalesce(front_head, F.col("head"), back_head).alias("seg_head"),
        F.coalesce(back_tail, F.col("tail"), front_tail).alias("seg_tail"))
    parted = checkpointed(
        sized.repartitionByRange("split", *ORDER)  # neighbouring small parts are one task
        .withColumn("part", F.spark_partition_id()))

    before = Window.partitionBy("split").orderBy("part")
    carried = (parted.groupBy("split", "part")
               .agg(F.sum("size").alias("part_size"),
                    F.max_by("seg_tail", F.when(F.col("size") > 0, F.struct(
                        F.col("doc_id").isNotNull(), *ORDER))).alias("part_tail"))
               .select("split", "part",
                       F.coalesce(F.sum("part_size").over(
                           before.rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("base"),
                       F.last("part_tail", ignorenulls=True).over(
                           before.rowsBetween(Window.unboundedPreceding, -1)
                       ).alias("base_tail"),
                       F.sum("part_size").over(Window.partitionBy("split")).alias("length")))
    inside = (Window.partitionBy("split", "part").orderBy(*ORDER)
              .rowsBetween(Window.unboundedPreceding, -1))
    # One row per part and split: bounded by the number of tasks.
    placed = parted.join(F.broadcast(carried), ["split", "part"])
    return placed.select(
        "split", *ORDER, "is_first", "is_last", "size", "seg_head",
        F.coalesce(F.last("seg_tail", ignorenulls=True).over(inside),
                   F.col("base_tail")).alias("prev_tail"),
        (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"),
        "length")


def segments(stored: DataFrame, placed: DataFrame, joining: Joining) -> DataFrame:
    """``(split, doc_id, start, length, seg)``: each document's ids with their position."""
    return (stored.select("split", "doc_id", "row", "ids")
            .join(placed.select("split", "row", "is_first", "is_last", "start", "length"),
                  ["split", "row"])
            .select("split", "doc_id", "start", "length", _segment(joining).alias("seg")))


def stream_positions(segs: DataFrame) -> DataFrame:
    """``(split, pos, id)``: the stream in long form."""
    return segs.select("split", "start", F.posexplode("seg").alias("i", "id")).select(
        "split", (F.col("start") + F.col("i")).alias("pos"), "id")


def stream_lengths(stored: DataFrame, joining: Joining) -> DataFrame:
    """``(split, length)`` from the document lengths alone."""
    fixed = len(joining.prefix) + len(joining.suffix)
    joints = F.count(F.lit(1)) - 1
    return stored.groupBy("split").agg(
        (F.sum("n") + fixed + joints * len(joining.joint)).cast("bigint").alias("length"))


def _pairs_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The adjacent ids of each list of the last column as one number, and the row of each."""
    lists = part.columns[-1]
    ends = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    inside = row[:-1] == row[1:]
    return (ids[:-1] << 32 | ids[1:] & 0xFFFFFFFF)[inside], row[:-1][inside]


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers with their counts added up."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[heads], np.add.reduceat(n, heads)


def _pairs_counted(names: list[str]):
    """Tasks from ``(*names, seg)`` to ``(*names, prev, cur, n)``: pairs are added up in the
    task, which holds at most ``HELD`` different ones and the pairs of one part."""
    def run(batches):
        held: dict[tuple, tuple[list, list]] = {}  # by the values of names
        schema, size = None, 0

        def rows():
            for name, (keys, counts) in held.items():
                key, n = _added(keys, counts)
                yield pa.record_batch(
                    [pa.array([v] * len(key), schema.field(i).type) for i, v in enumerate(name)]
                    + [pa.array((key >> 32).astype(np.int32)), pa.array(key.astype(np.int32)),
                       pa.array(n)], [*names, "prev", "cur", "n"])
            held.clear()

        for part in parts_of_batches(batches):
            schema = part.schema
            group: dict[tuple, int] = {}
            of = np.array([group.setdefault(name, len(group)) for name in zip(
                *(c.to_pylist() for c in part.columns[:-1]))], np.int64)
            pairs, row = _pairs_of(part)
            by = of[row]
            for name, g in group.items():
                key, n = np.unique(pairs[by == g], return_counts=True)
                if len(key):
                    keys, counts = held.setdefault(name, ([], []))
                    keys.append(key)
                    counts.append(n)
                    size += len(key)
            if size > 2 * HELD:
                held.update({name: tuple([x] for x in _added(*kept)) for name, kept in held.items()})
                size = sum(len(keys[0]) for keys, _ in held.values())
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def pair_counts(stored: DataFrame, joining: Joining, placed: DataFrame | None = None,
                by: tuple[str, ...] = ()) -> DataFrame:
    """``(split, *by, prev, cur, n)``: adjacent id pairs of the streams, counted.

    Pairs inside a segment come from the arrays and are added up in each task.
    The pair across two documents is known at once when a joint id stands between them;
    otherwise the layout gives it, one row per document.
    ``by`` names extra columns of ``stored``, for instance a training slice.
    """
    keep = ["split", *by]
    segs = _placed(stored.select("split", *ORDER, "ids", *by)).select(
        *keep, "is_first", _segment(joining).alias("seg"))
    if joining.joint:
        lead = F.when(~F.col("is_first"), int_array(joining.joint[-1])).otherwise(int_array())
        segs = segs.withColumn("seg", F.concat(lead, F.col("seg")))
    kept = segs.select(*keep, "seg")
    counted = T.StructType([*kept.schema.fields[:-1], T.StructField("prev", T.IntegerType()),
                            T.StructField("cur", T.IntegerType()), T.StructField("n", T.LongType())])
    pairs = kept.mapInArrow(_pairs_counted(keep), counted)
    if not joining.joint:
        placed = layout(stored, joining) if placed is None else placed
        links = placed.where(F.col("prev_tail").isNotNull() & F.col("seg_head").isNotNull())
        if by:
            links = links.join(stored.select("split", "row", *by), ["split", "row"])
        pairs = pairs.unionByName(links.select(
            *keep, F.col("prev_tail").alias("prev"), F.col("seg_head").alias("cur"),
            F.lit(1).cast("bigint").alias("n")))
    return pairs.groupBy(*keep, "prev", "cur").agg(F.sum("n").alias("n"))


def weighted_pairs(stored: DataFrame, joining: Joining, placed: DataFrame,
                   pairs: DataFrame, context: int, batch: int) -> DataFrame:
    """``(split, prev, cur, n, weight)``: pair counts with their window-and-batch weight.

    All targets weigh the same except the first ``context`` and the last
    ``context + batch`` ones.  So counts times the common weight are right up to those
    edges, and the few documents that hold them supply the differences.
    """
    lengths = placed.where("is_first").select("split", "length")
    common = interior_weight(F.col("length"), context, batch)
    body = pairs.join(F.broadcast(lengths), "split").select(
        "split", "prev", "cur", "n", (F.col("n") * common).alias("weight"))
    near_end = F.col("length") - context - batch
    on_edge = (F.col("start") <= context) | (F.col("start") + F.col("size") >= near_end)
    edge_docs = placed.where(on_edge & (F.col("size") > 0))
    before = F.when(F.col("prev_tail").isNull(), int_array()).otherwise(
        F.array(F.col("prev_tail")))
    # Every edge document holds at least one edge position: bounded by context and batch.
    # Their ids lie at both ends of each split; the bounds prune the scan of the arrays.
    at_head = edge_docs.where(F.col("start") <= context).agg(F.max("doc_id")).scalar()
    at_tail = edge_docs.where(F.col("start") > context).agg(F.min("doc_id")).scalar()
    held = (stored.select("split", "doc_id", "row", "ids")
            .where(F.col("doc_id").isNull() | (F.col("doc_id") <= at_head)
                   | (F.col("doc_id") >= at_tail)).drop("doc_id")
            .join(F.broadcast(edge_docs), ["split", "row"])
            .withColumn("lead", F.size(before))
            .withColumn("seg", F.concat(before, _segment(joining))))
    edge = (held.select("split", "start", "length", "lead",
                        F.posexplode(neighbours(F.col("seg"))).alias("i", "p"))
            .withColumn("pos", F.col("start") - F.col("lead") + F.col("i") + 1)
            .where((F.col("pos") <= context) | (F.col("pos") >= near_end))
            .select("split", "p.prev", "p.cur", F.lit(0).cast("bigint").alias("n"),
                    (target_weight(F.col("pos"), F.col("length"), context, batch)
                     - common).alias("weight")))
    return body.unionByName(edge).groupBy("split", "prev", "cur").agg(
        F.sum("n").alias("n"), F.sum("weight").alias("weight"))


SIDES = ("ids", "text", "digest")


def _spelled_windows(blocks: DataFrame, context: int, stride: int, block: int,
                     digest: bool) -> DataFrame:
    """``(split, start, x, y)`` of blocks ``(split, base, length, ids)``, both sides as text.

    The ids of a block are spelled once and the windows are stretches of that text.  At
    stride 1 the ``y`` of a window is the ``x`` of the next one.
    """
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            for row in range(batch.num_rows):
                base, length = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                first = -(-base // stride) * stride
                last = min(base + block - 1, length - context - 1)
                if first > last:
                    continue
                words = [b"%d" % i for i in lists[row].values.to_numpy().tolist()]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(sizes + 1) - 1
                text = b" ".join(words)
                starts = np.arange(first, last + 1, stride)

                def sides(at):
                    cut = [text[a:b] for a, b in zip((ends - sizes)[at].tolist(),
                                                     ends[at + context - 1].tolist())]
                    return [md5(c, usedforsecurity=False).hexdigest() for c in cut] if digest else cut

                if stride == 1:
                    both = sides(np.append(starts, last + 1) - base)
                    x, y = both[:-1], both[1:]
                else:
                    x, y = sides(starts - base), sides(starts + 1 - base)
                split = pa.array([batch.column(0)[row].as_py()] * len(starts), pa.string())
                yield pa.record_batch([split, pa.array(starts), *(
                    pa.array(s, None if digest else pa.binary()).cast(pa.string())
                    for s in (x, y))], ["split", "start", "x", "y"])

    return blocks.select("split", "base", "length", "ids").mapInArrow(
        run, "split string, start bigint, x string, y string")


def next_token_windows(segs: DataFrame, context: int, stride: int = 1, block: int = 4096,
                       sides: str = "ids") -> DataFrame:
    """``(split, start, x, y)``: ``context`` ids and the same shifted by one; with ``sides``
    ``text`` the ids joined by a space, with ``digest`` the MD5 of that text.

    The stream is cut into blocks; each segment sends every block it touches one array
    slice, with ``context`` extra ids past the block's end.  A long document is thus
    spread over its blocks, and no group exceeds ``block + context`` ids.
    """
    if context < 1 or stride < 1:
        raise ValueError("context and stride must be positive")
    if sides not in SIDES:
        raise ValueError(f"unknown sides {sides!r}, expected one of {SIDES}")
    end = F.col("start") + F.size("seg") - 1
    # Block b holds positions b*block .. (b+1)*block + context - 1.
    low = F.greatest(F.floor((F.col("start") - context) / block), F.lit(0))
    high = F.floor(end / block)
    touched = (segs.where(F.size("seg") > 0)
               .select("split", "start", "length", "seg",
                       F.explode(F.sequence(low, high)).alias("b"))
               .withColumn("from", F.greatest(F.col("start"), F.col("b") * block))
               .withColumn("to", F.least(F.col("start") + F.size("seg"),
                                         (F.col("b") + 1) * block + context))
               .where(F.col("to") > F.col("from"))
               .select("split", "b", "length", "from",
                       F.slice("seg", (F.col("from") - F.col("start") + 1).cast("int"),
                               (F.col("to") - F.col("from")).cast("int")).alias("ids")))
    blocks = (touched.groupBy("split", "b")
              .agg(F.max("length").alias("length"),
                   F.sort_array(F.collect_list(F.struct("from", "ids"))).alias("parts"))
              .withColumn("ids", F.flatten(F.col("parts.ids")))
              .withColumn("base", F.col("b") * block))
    if sides != "ids":
        return _spelled_windows(blocks, context, stride, block, sides == "digest")
    # Starts in this block that are multiples of the stride and leave room for y.
    first = F.ceil(F.col("base") / stride) * stride
    last = F.least(F.col("base") + block - 1, F.col("length") - context - 1)
    starts = (blocks.where(first <= last)
              .select("split", "base", "ids",
                      F.explode(F.sequence(first, last, F.lit(stride).cast("bigint")))
                      .alias("start")))
    at = (F.col("start") - F.col("base") + 1).cast("int")
    return starts.select("split", "start",
                         F.slice("ids", at, F.lit(context)).alias("x"),
                         F.slice("ids", at + 1, F.lit(context)).alias("y"))


def split_sizes(lengths: DataFrame, context: int, batch: int, stride: int = 1) -> DataFrame:
    """``(split, n_tokens, n_windows, n_batches)`` by arithmetic on the stream length."""
    windows = F.ceil(F.greatest(F.col("length") - context, F.lit(0)) / stride)
    return lengths.select("split", F.col("length").alias("n_tokens"),
                          windows.alias("n_windows"),
                          F.ceil(windows / batch).alias("n_batches"))


def window_starts(lengths: DataFrame, context: int, stride: int = 1,
                  chunk: int = 10_000) -> DataFrame:
    """``(split, start)`` of every window, generated from the lengths alone.

    Three nested sequences of at most ``chunk`` elements each (the outer one longer only
    past ``chunk`` cubed); the work is spread after each of the first two.
    """
    last = F.col("length") - context - 1
    zero = F.lit(0).cast("bigint")
    inner, outer = chunk * stride, chunk * chunk * stride
    spread = (lengths.where(last >= 0)
              .select("split", last.alias("last"),
                      F.explode(F.sequence(zero, F.floor(last / outer))).alias("o"))
              .select("split", "last", (F.col("o") * outer).alias("low"))
              .repartition(parallelism(lengths.sparkSession), "split", "low"))
    chunks = spread.select("split", "last", "low", F.explode(F.sequence(zero, F.floor(
        F.least(F.col("last") - F.col("low"), F.lit(outer - 1)) / inner))).alias("c")).repartition(
            parallelism(lengths.sparkSession), "split", "low", "c")
    low = F.col("low") + F.col("c") * inner
    high = F.least(low + inner - stride, F.col("last"))
    return chunks.select("split", F.explode(
        F.sequence(low, high, F.lit(stride).cast("bigint"))).alias("start"))


def ordered_batches(starts: DataFrame, batch: int, stride: int = 1) -> DataFrame:
    """``(split, start, batch_id)`` in stream order; the last batch may be short."""
    return starts.withColumn(
        "batch_id", F.floor(F.col("start") / (stride * batch)).cast("bigint"))


def target_weights(positions: DataFrame, lengths: DataFrame, context: int,
                   batch: int) -> DataFrame:
    """``(split, pos, weight)`` of every target position of a stream."""
    return (positions.where(F.col("pos") >= 1)
            .join(F.broadcast(lengths), "split")
            .select("split", "pos", target_weight(F.col("pos"), F.col("length"), context,
                                                  batch).alias("weight")))
