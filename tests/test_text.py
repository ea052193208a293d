"""Column functions against plain Python, on hand fixtures and random strings."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphloom.functions import text as X

FIXTURES = ["", " ", "x", "  a\tb ", "a b c　d\x85e\x1cf\x1dg", "<bos> a <unk> <pad>",
            "aé", "日本", "a😀", "é", "line\nline\n\nend", "snake_case x1²", "a\0b", "ʹ·‿"]


def _random_texts(n=400):
    rng = random.Random(7)
    pool = "ab é日😀\t\n \x1c .,!?_-0²́‍<>" + "".join(chr(rng.randrange(1, 0xD7FF))
                                                          for _ in range(40))
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return FIXTURES + _random_texts()


def _map(spark, values, column, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    got = {r.i: r.o for r in df.select("i", column(F.col("v")).alias("o")).collect()}
    return [got[i] for i in range(len(values))]


def test_whitespace_tokens(spark, texts):
    want = [v.split() for v in texts]
    assert _map(spark, texts, X.whitespace_tokens) == want


def test_byte_round_trip(spark, texts):
    ids = _map(spark, texts, X.byte_ids)
    assert ids == [[b + 4 for b in v.encode()] for v in texts]
    assert _map(spark, ids, X.bytes_to_text, "v array<int>") == texts


def test_lengths_count_code_points_and_bytes(spark):
    assert _map(spark, ["a😀"], F.char_length) == [2]
    assert _map(spark, ["a😀"], F.octet_length) == [5]


def test_invalid_bytes_are_dropped(spark):
    rng = random.Random(3)
    odd = [0xEF, 0xBF, 0xBD, 0xE2, 0xF0, 0x80, 0x90, 0x41, 1, 0xED, 0xA0, 0xC0, 0xF4]
    rows = [[rng.choice(odd + [rng.randrange(256)]) for _ in range(rng.randrange(13))]
            for _ in range(2000)]
    want = [bytes(r).decode("utf-8", errors="ignore") for r in rows]
    assert _map(spark, [[b + 4 for b in r] for r in rows], X.bytes_to_text,
                "v array<int>") == want
    assert _map(spark, [[2, 199, 3]], X.bytes_to_text, "v array<int>") == [""]


def test_byte_id_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        _map(spark, [[260]], X.bytes_to_text, "v array<int>")


def test_one_line(spark):
    assert _map(spark, ["a\nb\n"], X.one_line) == ["a b "]


def test_with_specials(spark):
    assert _map(spark, [[], [9]], X.with_specials, "v array<int>") == [[2, 3], [2, 9, 3]]


def test_strip_specials(spark):
    values = ["<bos> a <unk> b <eos>", " <pad> ", "a<unk>b", "<<pad>pad>"]
    assert _map(spark, values, X.strip_specials) == ["a  b", "", "ab", "<pad>"]


def test_pretokens_match_the_library(spark, texts):
    from tokenizers import pre_tokenizers
    # Characters newer than Java's Unicode tables are classed differently; none here.
    safe = [t for t in FIXTURES + ["Ab,c!? d_e-f 1²x", "«été»", "日本。語"]]
    want = [[p for p, _ in pre_tokenizers.Whitespace().pre_tokenize_str(t)] for t in safe]
    assert _map(spark, safe, X.pretokens) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_properties(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert _map(spark, values, X.byte_ids) == [[b + 4 for b in v.encode()] for v in values]
    assert _map(spark, values, X.whitespace_tokens) == [
        v.split() for v in values]


def test_columns_work_on_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a b",), ("é",)], "text string").write.json(source)
    query = (spark.readStream.schema("text string").json(source)
             .select("text", X.with_specials(X.byte_ids(F.col("text"))).alias("ids"))
             .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start(sink))
    query.awaitTermination(60)
    got = {r.text: r.ids for r in spark.read.parquet(sink).collect()}
    assert got == {"a b": [2, 101, 36, 102, 3], "é": [2, 199, 173, 3]}
