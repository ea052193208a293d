import zlib

import pytest
from tests.llm.conftest import words
from tests.llm.test_quality import sample

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = sample()
    item = words(9000, 30)
    rows += [(1, words(50, 200)), (2, words(50, 200)), (3, words(51, 80) + " " + item),
             (4, words(52, 80) + " token = " + "0123456789abcdef" * 2), (None, words(53, 90)),
             (5, words(54, 90)), (5, words(54, 90))]
    docs = [(i, t, "en", f"s{n % 4}", len(t)) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).selectExpr("*", "'a' score", "'b' spans", "'c' label").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, dict(labels_of(labels)), rows


def labels_of(labels):
    return [(d, q) for d, q, _ in labels]


def test_stages(spark, folder, tmp_path):
    path, quality, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.columns == columns
        kept.append(docs.collect())
    ids = [[r.doc_id for r in part] for part in kept]
    wrong = [d for d, q in quality.items() if (d in ids[0]) != bool(q)]
    assert len(wrong) <= 0.05 * len(quality)
    assert {1, 2, 3, 4, 5, None} <= set(ids[0])
    assert 2 not in ids[1] and {1, 3, 4, 5, None} <= set(ids[1]) and ids[1].count(5) == 1
    assert 3 not in ids[2] and set(ids[1]) - set(ids[2]) == {3}
    text = {r.doc_id: r for r in kept[3]}[4]
    assert text.text.endswith("[secret]") and text.n_chars == len(text.text)
    assert sorted(ids[3], key=repr) == sorted(ids[2], key=repr)
    assert sorted({r.doc_id for r in kept[4]}, key=repr) == sorted(set(ids[3]), key=repr)


def test_run_is_all_stages(spark, folder):
    path, *_ = folder
    assert corpus_pipeline.ORACLE_SQL is None
    found = __spark_entry__.queries()["pipeline"](spark, path)
    assert found.columns[0] == "doc_id" and found.count() > 100


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
