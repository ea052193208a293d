import itertools
import random
import zlib

import numpy as np
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from glyphloom.llm import packing

TRICKY = [(50, "a  b\n c \n\n d\te <|endoftext|> f<|endoftext|>g  "), (51, "don't I'll 's x's  'S"),
          (52, "日本 語 ǆ ʼn ᏸ x   y\x1cz \x85 q"), (53, " lead and trail "),
          (54, "1 22 333, ,, ..." * 900)]


def test_every_id_once_and_windows_gapless(frame, spark):
    rows = ODD + TRICKY
    window = 64
    found = packing.pack(frame(rows), window=window).collect()
    full = Tokenizer.from_file(packing.default_paths()[0])
    want = {}
    for doc, text in rows:
        ids = np.array(full.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), window):
            part = ids[at:at + window]
            key = (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    got = {}
    places = {}
    for r in found:
        key = (r.id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(places) == list(range(len(places)))


def test_empty_table(frame):
    assert packing.pack(frame([])).collect() == []


def test_tables_of_both_libraries_agree():
    both = packing.ChunkEncoder(*packing.default_paths())
    one = packing.ChunkEncoder(packing.default_paths()[0], None)
    for _, text in ODD + TRICKY:
        assert both.encode(text or "") == one.encode(text or "")
        assert list(np.frombuffer(one.encode(text or ""), "<u4")) == one.full.encode(
            text or "", add_special_tokens=False).ids


def test_fill_is_the_best_subset():
    draw = random.Random(4)
    for _ in range(200):
        room = draw.randint(0, 30)
        counts = {draw.randint(1, 12): draw.randint(1, 3) for _ in range(draw.randint(0, 4))}
        items = [n for n, c in counts.items() for _ in range(c)]
        best = max(sum(s) for k in range(len(items) + 1)
                   for s in itertools.combinations(items, k) if sum(s) <= room)
        used = packing.best_fill(room, counts)
        assert sum(n * c for n, c in used.items()) == best
        assert all(c <= counts[n] for n, c in used.items())


def test_plan_uses_every_piece_once():
    draw = random.Random(6)
    counts = {draw.randint(1, 2048): draw.randint(1, 400) for _ in range(300)}
    plan = packing.plan_windows(dict(counts))
    left = dict.fromkeys(counts, 0)
    for times, used in plan:
        assert sum(n * c for n, c in used.items()) <= 2048
        for n, c in used.items():
            left[n] += times * c
    assert left == counts
    filled = sum(n * c for n, c in counts.items()) / sum(t for t, _ in plan) / 2048
    assert filled > 0.98
