import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from glyphloom.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8",
                            spark__ui__enabled="false", spark__driver__memory="8g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def make_docs(spark):
    """Documents of the train split from a list of texts, ids by position."""
    def make(texts, split="train", parts=None):
        rows = [(split, i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "split string, doc_id bigint, text string")
        return df.repartition(parts, "doc_id") if parts else df
    return make


@pytest.fixture
def make_encoded(spark):
    def make(lists, split="train", parts=None):
        rows = [(split, i, ids) for i, ids in enumerate(lists)]
        df = spark.createDataFrame(rows, "split string, doc_id bigint, ids array<int>")
        return df.repartition(parts, "doc_id") if parts else df
    return make
