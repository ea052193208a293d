"""Small documents with every kind of odd row."""

import pytest

CLASH = {"id": "x", "fp": 1, "label": "y", "score": 0.5, "spans": "s", "part": 3, "word": "w",
         "length": 7, "kept_text": "k", "row_no": 9, "oid": 2, "doc": 4}


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from ``(doc_id, text)`` rows, with clashing extra columns on demand."""
    def make(rows, clash=True, parts=3):
        rows = [(i, t, "en", f"src{n % 3}", None if t is None else len(t))
                for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in CLASH.items()})
        return df.repartition(parts)
    return make


def words(seed: int, count: int) -> str:
    """Plain invented prose."""
    import random

    draw = random.Random(seed)
    return " ".join("".join(draw.choice(("ka", "lo", "mi", "ter", "un", "ves", "or"))
                            for _ in range(draw.randint(1, 4))) for _ in range(count))


LONG = words(1, 4000)
ODD = [(None, None), (None, "only an unnamed text"), (1, None), (2, ""), (3, " \t\n"),
       (4, "one"), (5, LONG), (6, LONG), (6, LONG), (7, "one"), (7, "another text of seven"),
       (8, "é " * 30), (9, "a\u0000b   c")]
