import random

from pyspark.sql import functions as F

from backline.llm import contamination as C
from backline.llm.common import words_of
from .frames import ODD, docs


def words(text):
    return [w.decode() for w in words_of((text or "").encode())]


def windows(items, n=10):
    out = []
    for item, text in items:
        w = words(text)
        out += [(item, tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1))] if w else []
    return out


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item, phrase in windows(items):
        n = len(phrase)
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) == phrase:
                hit.update(range(s, s + n))
                ids.add(item)
    return len(w), len(hit), sorted(i for i in ids if i is not None)


def near(text, items, slop):
    w = words(text)
    ids = set()
    for item, phrase in windows(items):
        span = len(phrase) + slop
        if any(set(phrase) <= set(w[s : s + span]) for s in range(max(1, len(w) - 1))):
            ids.add(item)
    return sorted(ids)


def test_word_rule():
    assert words("It's A-Z 09, ñandú\x7f_x [Été]") == ["it", "s", "a", "z", "09", "ñandú", "x", "Été"]


def case(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(6))
    items = [(str(k), " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for k in range(25)] + [("7", "x y z"), ("dup", "x y z")]
    rows = []
    for d in range(60):
        t = [word() for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(t) + 1)
            item = rnd.choice(items)[1].split()
            if rnd.random() < 0.3:
                rnd.shuffle(item)
            t[at:at] = item[: rnd.choice([12, 40])]
        rows.append((d, ", ".join(t).upper() if d % 2 else " ".join(t)))
    return rows, items


def test_equals_brute_force(spark):
    rows, items = case(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (8 << 20, 60):  # one slice, and many
        got = {r.id: r for r in C.contamination(docs(spark, rows), bench, slop=2, slice_bytes=size).collect()}
        for d, t in rows:
            assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == brute(t, items), (d, size)
            assert got[d].near_items == near(t, items, 2), (d, size)


def test_documents_do_not_run_into_each_other(spark):
    bench = spark.createDataFrame([("1", "a b c d")], "item_id string, text string")
    got = C.contamination(docs(spark, [(1, "a b"), (2, "c d"), (3, "a b c d")], parts=1), bench, slop=1).collect()
    assert {r.id: (r.n_hit, r.near_items) for r in got} == {1: (0, []), 2: (0, []), 3: (4, ["1"])}


def test_odd_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two"), (None, "a"), (2, None)], "item_id long, text string")
    frame = docs(spark, ODD, extra=("id", "segment", "items"))
    got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in C.contamination(frame, bench).collect()), key=str)
    want = sorted(((d, *brute(t, [("1", "one two"), (None, "a")])) for d, t in ODD), key=str)
    assert got == want
    assert C.contamination(docs(spark, []), bench).count() == 0
    assert C.contamination(frame, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = C.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(ODD) - 3
