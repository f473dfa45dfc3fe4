import random
from collections import defaultdict

import pytest

from backline.llm import chosen_path
from backline.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = words_of((text or "").encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id -> (class_id, n_links, group_id) by comparing all texts; ids must be distinct."""
    texts = defaultdict(list)
    for d, t in rows:
        texts[t or ""].append(d)
    names = {t: min(d) for t, d in texts.items()}
    sets = {t: shingles(t) for t in texts}
    links = defaultdict(set)
    every = [t for t in texts if sets[t]]
    for i, a in enumerate(every):
        for b in every[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    group = {}
    for t in sorted(texts, key=names.get):
        if t in group:
            continue
        todo = [t]
        group[t] = names[t]
        while todo:
            for u in links[todo.pop()]:
                if u not in group:
                    group[u] = names[t]
                    todo.append(u)
    return {d: (names[t or ""], len(links[t or ""]), group[t or ""]) for d, t in rows}


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(40))
    base = [[word() for _ in range(rnd.randrange(60, 200))] for _ in range(40)]
    passage = [word() for _ in range(60)]
    texts = [" ".join(b) for b in base] + [" ".join(passage + b) for b in base]
    for b in base[:8]:
        for _ in range(12):
            c = list(b)
            for _ in range(rnd.randrange(0, 5)):
                c[rnd.randrange(len(c))] = word()
            texts.append(" ".join(c))
    hot = base[9]
    texts += [" ".join(hot)] * 150 + [" ".join(hot[:k] + [word()] + hot[k + 1 :]) for k in range(len(hot))]
    texts += [None, "", "...", "!!!", "one two", "One, two!", "one two three four five", "ONE two three four five", "x " * 30000]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(7)
    return {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in chosen_path.jaccard_join(df).collect()}


def test_equals_brute_force_with_copies_passages_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "TILE", 32)  # nodes and clusters of several tiles
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(6)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    df = df.unionByName(df.where("doc_id = 3"))  # a row that stands twice
    kept = chosen_path.keep_one_of_each_group(df)
    assert kept.columns == df.columns
    want = {g for _, _, g in brute(rows).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c d e f")]])
def test_empty_table_and_null_ids(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = chosen_path.jaccard_join(df).collect()
    assert len(got) == len(rows) and all(r.n_links == 0 for r in got)


def test_groups_of_null_and_reused_ids_stay_apart(spark):
    far = ["red green blue black white grey", "one two three four five six", "north south east west up down", "...", "?!", "spring summer autumn winter dawn dusk"]
    near = "This that these those here there when where why how"
    rows = [(None, far[0]), (None, far[1]), (None, far[3]), (None, far[4]), (7, far[2]), (7, far[5]), (None, near), (3, near.upper()), (9, near + "!"), (None, None), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(3)
    got = chosen_path.jaccard_join(df).collect()
    assert len({r.group_key for r in got}) == 8
    assert {(r.group_id, r.n_links) for r in got if r.n_links} == {(3, 2)}
    kept = sorted((r.text or "" for r in chosen_path.keep_one_of_each_group(df).collect()), key=str)
    assert kept == sorted([*far, near, ""])
