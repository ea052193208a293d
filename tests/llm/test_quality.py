import zlib

import numpy as np
from tests.llm.conftest import ODD, words

from glyphloom.llm import quality
from glyphloom.llm.common import remainder


def sample():
    rows, labels = [], []
    for n in range(240):
        good = n % 3 > 0
        text = words(n, 60 + n)
        if not good:
            text = " ".join(w + "%%%" for w in text.split()) if n % 2 else " ".join(
                [text.split()[0]] * (60 + n))
        rows.append((1000 + n, text))
        labels.append((1000 + n, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(frame, spark):
    rows, labels = sample()
    marks = spark.createDataFrame(labels + [(None, 1, 0), (1003, None, None)],
                                  "doc_id bigint, quality int, toxic int")
    model = quality.train(frame(rows + ODD), marks)
    docs = frame(rows + ODD)
    scored = quality.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    found = scored.select("doc_id", "score").collect()
    assert len(found) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.score for r in found}
    held = [(by[d] >= 0.3, bool(q)) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) >= 0.95


def test_held_out_labels_are_not_read(frame, spark):
    rows, labels = sample()
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    kind = "doc_id bigint, quality int, toxic int"
    docs = frame(rows)
    assert quality.train(docs, spark.createDataFrame(labels, kind)) == quality.train(
        docs, spark.createDataFrame(flipped, kind))


def test_no_labels_and_empty_tables(frame, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.train(frame([(1, "x")]), none)
    assert [r.score for r in quality.score(frame([(1, "x"), (2, None)]), model).collect()] == [0.5] * 2
    one = quality.train(frame([(1, "x y z")]), spark.createDataFrame([(1, 1)], none.schema))
    assert all(r.score >= 0.5 for r in quality.score(frame([(1, "x")]), one).collect())
    assert quality.score(frame([]), model).collect() == []


def test_remainder_is_crc32(spark):
    from pyspark.sql import functions as F

    rows = spark.range(300).select("id", remainder(F.col("id")).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_a_repeated_id_teaches_one_text(frame, spark):
    rows, labels = sample()
    kind = "doc_id bigint, quality int, toxic int"
    marks = spark.createDataFrame(labels, kind)
    again = [(rows[0][0], rows[0][1] + f" copy {n}") for n in range(300)]
    model = quality.train(frame(rows + again), marks)
    hashed = frame([rows[0], *again], clash=False).selectExpr("text", "xxhash64(text) h")
    least = hashed.orderBy("h").first().text
    assert model == quality.train(frame([(rows[0][0], least), *rows[1:]]), marks)
