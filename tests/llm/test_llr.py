import math
import random
import re

import xxhash

from backline.llm import llr
from .frames import ODD, docs

LABELS = "doc_id long, quality int, toxic int"


def bucket(words, n):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    signed = seed - (1 << 64) if seed >> 63 else seed
    return signed % n


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, good, buckets, threshold):
    raw, target = [0] * buckets, [0] * buckets
    grams = {}
    for d, t in rows:
        w = words(t)
        g = [bucket([x], buckets) for x in w] + [bucket(p, buckets) for p in zip(w, w[1:])]
        grams[d, t] = g
        for b in g:
            raw[b] += 1
            target[b] += d in good
    n, m = sum(raw) + buckets, sum(target) + buckets
    ratio = [math.log((t + 1) / m) - math.log((r + 1) / n) for r, t in zip(raw, target)] if sum(target) else [0.0] * buckets
    out = {}
    for d, t in rows:
        w, text = words(t), t or ""
        lines = [x for x in text.split("\n") if words(x)]
        tri = list(zip(w, w[1:], w[2:]))
        cover = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)} if len(w) < 3000 else set(range(len(w)))
        score = sum(ratio[b] for b in grams[d, t]) / len(grams[d, t]) if w else 0.0
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out[d, t] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed, not failed and score >= threshold, round(score, 9))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    good_words, bad_words = [f"w{k}" for k in range(60)], ["$$$", "buy%", "#1", "é|", "<b>"]
    rows = []
    for d in range(80):
        pool = bad_words if d % 5 == 0 else good_words
        line = lambda: " ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14)))
        lines = [line() for _ in range(rnd.randrange(1, 14))]
        if d % 7 == 0:
            lines += [lines[0], "  \x0b", ""]
        rows.append((d, rnd.choice(["\n", "\n\n", "\r\n", " \n\t"]).join(lines)))
    rows += [(d + 1000, t) for d, t in ODD if d is not None]
    rows = [(d, t) for d, t in dict.fromkeys(rows)]
    labels = [(d, int(d % 5 != 0), 0) for d in range(0, 80, 2)] + [(4, 0, 0), (None, 1, 0), (2, None, None)]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    frame = docs(spark, rows, extra=("score", "i", "good"))
    got = llr.quality_rules(frame.drop("score"), spark.createDataFrame(labels, LABELS), buckets=512, threshold=-0.1)
    want = brute(rows, good, 512, -0.1)
    seen = got.collect()
    assert len(seen) == len(rows)
    for r in seen:
        mine = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 9))
        assert mine == want[r.doc_id, r.text], r.doc_id
    assert got.where("kept").count() == sum(v[6] for v in want.values())  # a filter on top changes nothing


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in llr.quality_rules(docs(spark, ODD), none).collect()} == {0.0}
    assert llr.quality_rules(docs(spark, []), none).count() == 0
