import math
import random
import re
from collections import Counter

import pytest

from backline.llm import masks as M
from .frames import ODD, docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(rows, items, k=10):
    words = [(d, terms(t)) for d, t in rows]
    held = [w for _, w in words if w]
    N, L = len(held), sum(map(len, held))
    df = Counter(t for w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in words:
            tf, n = Counter(w), len(w)
            if n:
                m = 100 - 75 + (75 * n * N) // L
                score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
                if score > 0:
                    scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, rows, items, **options):
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = M.ranked_search(docs(spark, rows, extra=("score", "item", "rank")), frame, **options)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(M, "SEGMENT_DOCS", [8192, 40, 7, 100][seed])
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    word = lambda: words[min(int(rnd.expovariate(0.05)), 119)]
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for i in range(500)]
    rows += [(900 + i, rows[3][1]) for i in range(30)]  # copies tie
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 90)))) for i in range(12)] + [(3, "w1 W1, w1 w40"), (77, "nowhere")]
    assert run(spark, rows, items) == brute(rows, items)


def test_odd_rows_and_slices(spark):
    rows = ODD + [(i, "Été 2024! one, two; word %d" % i) for i in range(20, 40)]
    items = [(1, "ONE word"), (1, "ONE word"), (2, None), (3, ""), (None, "été two"), (4, "漢字 a")]
    assert run(spark, rows, items) == brute(rows, items)
    assert run(spark, rows, items, slice_bytes=8) == brute(rows, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_groups_share_their_terms(spark):
    rows = [(i, "x" if i % 3 else "x y") for i in range(60)]
    row = M.build_segments(docs(spark, rows, parts=1), [b"x", b"y"]).first().asDict()
    segment = M.Segment(row, 60, 80)
    order, starts, holds = segment.masks(M.np.array([0, 1]))
    groups = {tuple(h): {segment.ids[d] % 3 == 0 for d in order[a:b]} for h, a, b in zip(holds.tolist(), starts, starts[1:])}
    assert groups == {(1, 0): {False}, (1, 1): {True}}
