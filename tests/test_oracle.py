"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from glyphloom.catalog.queries import QUERIES
from glyphloom.catalog.sql import SQL
from oracle import connect, differences



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in SQL:
        want = connect(sf_dir).execute(SQL[name]).df()
        assert differences(got, want) is None


def test_only_trained_pieces_have_no_sql():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(SQL) <= set(QUERIES) and set(SQL) <= set(entry_module.oracle_sql())
    assert {n for n in QUERIES if n not in SQL} == {
        "unigram_vocab", "unigram_encode", "unigram_decode", "run_metrics_subword"}


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4
