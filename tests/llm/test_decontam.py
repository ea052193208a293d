import random

from tests.llm.conftest import ODD, words

from glyphloom.llm import decontam


def distance(pattern, text):
    """Least edits of the pattern to any stretch of the text, by the plain table."""
    above = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        row = [i + 1]
        for j, t in enumerate(text):
            row.append(min(above[j] + (p != t), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def test_bit_parallel_distance():
    draw = random.Random(1)
    for _ in range(300):
        p = [draw.randint(1, 5) for _ in range(draw.randint(1, 90))]
        t = [draw.randint(1, 5) for _ in range(draw.randint(0, 60))]
        assert decontam.edit_search(p, t)[0] == distance(p, t)


def test_finds_what_brute_force_finds(frame, spark):
    draw = random.Random(2)
    items = [(n, words(500 + n, draw.randint(5, 60))) for n in range(25)]
    items += [(90, None), (91, ""), (None, words(500, 20)), (92, items[0][1])]
    rows = list(ODD)
    for n in range(60):
        item = items[n % 25][1].split()
        for _ in range(int(len(item) * 0.2 * draw.random())):
            item[draw.randrange(len(item))] = draw.choice(("new", "und"))
        place = words(900 + n, 40).split()
        cut = draw.randrange(41)
        rows.append((100 + n, " ".join(place[:cut] + (item if n % 2 else []) + place[cut:])))
    rows.append((300, words(7, 300) + " " + items[3][1].upper() + "; " + words(8, 5)))
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr(
        "*", "'x' id", "1 edits")
    found = {(r.id, r.item_id): r.edits for r in
             decontam.contamination(frame(rows), bench, block_items=7).collect()}
    want = {}
    for doc, text in rows:
        marks = decontam.words_of((text or "").encode())
        for item, passage in items:
            pattern = decontam.words_of((passage or "").encode())
            if pattern and (d := distance(pattern, marks)) <= int(len(pattern) * 0.2 + 1e-9):
                want[doc, item] = d
    assert set(found) <= set(want)
    assert len(found) >= 0.95 * len(want) and len(want) > 30
    assert all(found[k] >= want[k] for k in found)
    assert {k for k, d in want.items() if d == 0} <= {k for k, d in found.items() if d == 0}


def test_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(frame(ODD), none).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f"), (2, None)], none.schema)
    assert decontam.contamination(frame([]), some).collect() == []


def test_measured_recall_reaches_its_target():
    draw = random.Random(3)
    items = [(n, words(n, draw.randint(10, 50))) for n in range(40)]
    index = decontam.build_index(items, recall=0.97)
    hits = trials = 0
    for item, text in items:
        for _ in range(5):
            found = text.split()
            for _ in range(int(len(found) * 0.2)):
                found[draw.randrange(len(found))] = "zzz"
            text2 = (words(item + 70, 30) + " " + " ".join(found) + " " + words(item + 71, 30)).encode()
            hits += any(index.item_ids[i] == item for _, i, *_ in decontam.find_items(index, [text2]))
            trials += 1
    assert hits >= 0.93 * trials
