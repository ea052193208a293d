import random
import re
from collections import Counter

import pytest

from glyphloom.llm import phrases
from tests.llm.conftest import ODD, words


def plain(rows, least=10, longest=3, inside=50, top=2000):
    """Every phrase counted in full; rows ``(lang, text)``."""
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            found = re.findall("[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(found)
            for m in range(1, longest + 1):
                counts.update((lang or "und", *found[i:i + m]) for i in range(len(found) - m + 1))
    rows = {}
    for (lang, *w), a in counts.items():
        if len(w) < 2 or a < least:
            continue
        score, _, left, right = min(
            (1000000 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k,
             counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
        rows[lang, *w] = (a, left, right, score)
    dropped = {(lang, *w[i:i + m]) for lang, *w in rows for m in range(2, len(w))
               for i in range(len(w) - m + 1)
               if 100 * rows[lang, *w][0] >= inside * rows[lang, *w[i:i + m]][0]}
    out = []
    for lang in sizes:
        kept = sorted((-s, -a, " ".join(w).encode(), left, right) for (x, *w), (a, left, right, s)
                      in rows.items() if x == lang and (x, *w) not in dropped)
        out += [(lang, k, p.decode(), -a, left, right, sizes[lang], -s)
                for k, (s, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out)


def corpus():
    draw = random.Random(3)
    stock = words(9, 40).split() + ["The", "of", "é\u0001", "new", "New", "x\u0000y"]
    lines = [" ".join(draw.choice(stock) for _ in range(8)) for _ in range(6)]
    out = []
    for n in range(150):
        parts = [draw.choice(lines) if draw.random() < 0.5 else " ".join(
            draw.choice(stock[:15]) for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 5))]
        out.append((draw.choice(["en", "de", None, "l\u0000g"]), draw.choice([". ", "\t", "\n", " , ", "  "]).join(parts)))
    return out + [("en", t) for _, t in ODD] + [("fr", "no phrase here")] + out[:20]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(corpus(), "lang string, text string").selectExpr(
        "*", "'p' phrase", "1 n", "2 a", "'w' word", "3 part").repartition(3)


def got(table, **kind):
    return sorted(map(tuple, phrases.top_phrases(table, **kind).collect()))


def test_equals_counting_everything(table):
    want = plain(corpus())
    assert got(table) == want and len(want) > 100


def test_hot_words_are_extended(table, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 40)
    monkeypatch.setattr(phrases, "PLACES", 500)
    assert got(table, budget=100, longest=4, least=5, inside=80, top=30) == plain(
        corpus(), 5, 4, 80, 30)


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 64)
    rows = [("en", words(5, 30).replace("ka", "ka ") * 30), ("en", "q" * 500 + " " + "ab cd " * 40), ("en", "")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(df) == plain(rows)


def test_empty_tables(table):
    assert got(table.limit(0)) == []
    assert got(table.where("text IS NULL")) == []
    assert got(table.withColumn("text", phrases.F.lit(""))) == []
