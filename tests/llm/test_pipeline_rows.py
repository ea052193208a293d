"""Rows of the pipeline that share an id, or have none."""

import pytest
from tests.llm.conftest import words

import corpus_pipeline


@pytest.fixture(scope="module")
def benchmark(spark, tmp_path_factory):
    path, item = str(tmp_path_factory.mktemp("rows")), words(9000, 30)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, item


def kept(stage, spark, frame, rows, path, parts=3):
    found = stage(spark, frame(rows, parts=parts), path)
    return sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)


def test_near_dedup_tells_rows_apart(spark, frame):
    one, other, third = words(1, 200), words(2, 200), words(3, 200)
    rows = [(4, one), (7, one), (7, other), (7, other), (None, third), (None, third),
            (None, other), (8, None), (9, "")]
    for parts in (1, 3):
        assert kept(corpus_pipeline.near_dedup, spark, frame, rows, "", parts) == sorted(
            [(4, one), (7, other), (None, third), (8, None)], key=repr)


def test_decontaminate_tells_rows_apart(spark, frame, benchmark):
    path, item = benchmark
    leak, clean = words(4, 60) + " " + item, words(5, 80)
    rows = [(None, leak), (None, clean), (3, leak), (3, clean), (4, None)]
    assert kept(corpus_pipeline.decontaminate, spark, frame, rows, path) == sorted(
        [(None, clean), (3, clean), (4, None)], key=repr)
