"""Quality scores from compressed sizes under a good and a bad zstandard dictionary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphloom.llm.common import arrow_stage, as_bytes, remainder

BLOCK = 1024
LEVEL = 3
PLAIN = 0.6  # sizes above this share of the length are not told apart
SHORT = 64.0
FEATURES = 5


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration ``1 / (1 + exp(-(bias + weights . features)))``."""

    good: bytes
    bad: bytes
    bias: float
    weights: tuple[float, ...]


def _blocks(text: bytes, block: int) -> list[bytes]:
    return [text[i:i + block] for i in range(0, len(text), block)]


def build_dictionary(texts: list[bytes], size: int, block: int = BLOCK) -> bytes:
    """A trained dictionary; where the texts are too few to train on, their raw tail."""
    import zstandard

    samples = [b for t in texts for b in _blocks(t, block)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text's blocks under both dictionaries.

    Each block is compressed by itself, so that a long text is judged as a short one is: it
    cannot become its own dictionary.
    """

    def __init__(self, model: Model, block: int = BLOCK, level: int = LEVEL):
        import zstandard

        self.block = block
        self.packers = []
        for content in (model.good, model.bad):
            held = None
            if content:
                held = zstandard.ZstdCompressionDict(content)
                held.precompute_compress(level=level)
            options = {"dict_data": held} if held else {"level": level}
            self.packers.append(zstandard.ZstdCompressor(
                write_content_size=False, write_checksum=False, write_dict_id=False, **options))

    def features(self, text: bytes) -> list[float]:
        """Of the whole text: the difference of both sizes over their sum; how evenly the
        blocks agree on its sign; the size over the length, mean and least block (repeated
        words shrink under any dictionary); and how short the text is, since the sizes of a
        few bytes say little.  A tail shorter than a block joins the block before it."""
        blocks = _blocks(text, self.block)
        if len(blocks) > 1 and len(blocks[-1]) < self.block:
            tail = blocks.pop()
            blocks[-1] += tail
        good, bad = self.packers
        sizes = np.array([(len(good.compress(b)), len(bad.compress(b)), len(b))
                          for b in blocks or [b""]], float)
        first, second, length = sizes.sum(0)
        ratio = np.minimum(sizes[:, 0] / np.maximum(sizes[:, 2], 1), PLAIN)
        short = np.exp(-length / SHORT)
        return [(second - first) / (second + first) * (1 - short),
                float(np.sign(sizes[:, 1] - sizes[:, 0]).mean()) * (1 - short),
                float(ratio.mean()), float(ratio.min()), short]


def calibrate(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3,
              steps: int = 50) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by Newton's method; one class only: its smoothed rate."""
    x = np.column_stack([np.ones(len(labels)), features])
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    if 0 < labels.sum() < len(labels):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grade = x.T @ (labels - p) - ridge * beta
            curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
            move = np.linalg.solve(curve, grade)
            beta += np.clip(move, -5, 5)
            if np.abs(move).max() < 1e-8:
                break
    return float(beta[0]), tuple(float(b) for b in beta[1:])


def _window(limit: int):
    """At most ``limit`` characters of a text, from a place drawn by its id."""
    spare = F.greatest(F.length("text") - limit, F.lit(0)) + 1
    return F.substring(F.col("text"), F.pmod(F.xxhash64("id"), spare.cast("bigint")).cast("int") + 1,
                       F.lit(limit))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_class: int = 2000, chars: int = 16_384,
          dict_size: int = 65_536) -> Model:
    """Dictionaries and calibration from labelled rows outside the held-out fold.

    The sample is bounded: of each class the ``per_class`` labelled ids of smallest hash,
    and of a text longer than ``chars`` characters one window at a hashed place.  Half of
    the sample builds the dictionaries, the other half calibrates the score.  Only the
    label and the text are read.  Null labels, ids or texts are not learned from; of several
    texts under one id the one of smallest hash is; an id labelled both ways counts in both
    classes.  A class without rows, an empty table among them, leaves its dictionary empty
    and the score at the smoothed class rate.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & (remainder(F.col("id")) != 0))
    draw = F.xxhash64("id", F.lit("sample"))
    chosen = None
    for value in (0, 1):
        part = marked.where(F.col("label") == value).dropDuplicates(["id"]).orderBy(
            draw, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # One row for an id, so that the sample stays bounded where an id repeats.
    rows = texts.where("text IS NOT NULL").join(F.broadcast(chosen), "id").select(
        "id", "label", _window(chars).alias("text")).groupBy("id", "label").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.id, r.label))
    halves: dict[int, list[list[bytes]]] = {0: [[], []], 1: [[], []]}
    for row in rows:
        side = halves[int(row.label)]
        side[len(side[0]) > len(side[1])].append(row.text.encode())
    model = Model(build_dictionary(halves[1][0], dict_size) if halves[1][0] else b"",
                  build_dictionary(halves[0][0], dict_size) if halves[0][0] else b"",
                  0.0, (0.0,) * FEATURES)
    sizes = Sizes(model)
    held = [(sizes.features(t), value) for value in (0, 1) for t in halves[value][1]]
    found = np.array([f for f, _ in held], float).reshape(-1, FEATURES)
    bias, weights = calibrate(found, np.array([v for _, v in held], float))
    return Model(model.good, model.bad, bias, weights)


def score(docs: DataFrame, model: Model, text_col: str = "text",
          into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, 0 to 1, from the whole text; no shuffle.

    A null text is scored as an empty one.  All columns and rows are kept; an input column
    called ``into`` is replaced.
    """
    from pyspark.sql import types as T

    columns = [c for c in docs.columns if c != into]
    source = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in columns),
                           T.StructField(into, T.DoubleType())])

    def run(batches):
        sizes = Sizes(model)
        for batch in batches:
            found = np.array([sizes.features(t) for t in as_bytes(batch.column(len(columns)))],
                             float).reshape(-1, FEATURES)
            line = np.clip(model.bias + found @ np.array(model.weights), -30, 30)
            yield pa.record_batch([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-line)))],
                                  [*columns, into])

    return arrow_stage(source, run, schema)
