"""The registered queries over whole tables at the smallest scale."""

import pytest
from oracle import connect, differences

from glyphloom.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1": "doc_id item_id edits similarity first_word end_word",
    "op2": "doc_id class_id n_passages spans",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "doc_id held_out score predicted",
    "op5": "doc_id fingerprint component_id",
    "op6": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7": "vec_id n_links component_id kept",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10": "page_id url text n_chars",
    "op12": "doc_id held_out lang_pred score",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op11": "lang rank phrase a l r n score",
}
ALL_ROWS = {"op4": 200, "op5": 200, "op6": 200, "op7": 500, "op8": 200, "op9": 200, "op10": 50, "op12": 200, "op13": 200}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    number = name.split("_")[0]
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert list(got.columns) == COLUMNS[number].split()
    assert len(got) == ALL_ROWS.get(number, len(got)) and len(got) > 0
    if name in SQL:
        assert differences(got, connect(sf_dir).execute(SQL[name]).df()) is None
