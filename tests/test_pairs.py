"""Matching and duplicate detection against brute force over small frames with hot groups."""

import datetime as dt
import itertools
import random

import pytest

from pyspark.sql import functions as F

from backline.functions import vectors as V
from backline.operators import normalize, pairs
from backline.session import cut_lineage
from backline.sources import tables


def test_contained_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    words = ["arena", "royal", "hall", "ub", "a", "metro", "the o2", "club", "garden", "x"]
    texts = list({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(120)})
    small = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "a long, a_text string")
    big = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "b long, b_text string")
    got = {(r.a, r.b) for r in pairs.contained_pairs(small, big).collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if s in t}


def test_contained_in_blocks_small_and_large(spark):
    rng = random.Random(3)
    words = ["arena", "royal", "hall", "ub", "a", "metro", "the o2", "club", "garden", "x"]
    texts = list({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(120)})
    rows = [(0, i, t) for i, t in enumerate(texts)] + [(1 + i % 30, 1000 + i, t) for i, t in enumerate(texts)]
    assert sum(r[0] == 0 for r in rows) > 64  # beyond the bound of a block that is compared as it is
    small = spark.createDataFrame(rows, "day long, a long, a_text string")
    got = [(r.day, r.a, r.b) for r in pairs.contained_in_blocks(small, small.toDF("day", "b", "b_text"), ["day"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, i, j) for k, i, s in rows for h, j, t in rows if k == h and s in t}


def test_only_concerts_with_a_neighbour_are_paired(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 1, d), (2, 1, d + dt.timedelta(1)), (3, 1, d + dt.timedelta(3)), (4, 2, d), (5, 3, d), (6, 3, d), (7, 1, None), (8, None, d), (9, None, d)]
    df = spark.createDataFrame([(*r, "Pune", "Dome") for r in rows], "concert_id long, artist_id long, concert_date date, city string, venue_name string")
    assert {r.concert_id for r in pairs._with_neighbours(df).collect()} == {1, 2, 5, 6}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52)], "a long, b long")
    got = {r.node: r.root for r in pairs.components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50, 52: 50}


def linked(a, b):
    if a[1] != b[1] or abs((a[2] - b[2]).days) > 1:
        return False
    c1, c2 = (x[3].lower() for x in (a, b))
    if (c1 and c2 and c1 != c2) or (not c1 and not c2):
        return False
    v1, v2 = (x[4].lower() for x in (a, b))
    if not v1 or not v2:
        return True
    lead = [next((w for w in v.split() if len(w) > 3), None) for v in (v1, v2)]
    return v1 == v2 or v1 in v2 or v2 in v1 or (lead[0] is not None and lead[0] == lead[1])


def test_duplicate_groups_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(220):
        hot = i % 3 == 0  # a third of the rows is one artist
        day = dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 3 if hot else 60))
        rows.append((i, 1 if hot else rng.randint(2, 6), day, rng.choice(["", "Pune", "Oslo", "Rome", "Lima", "Kyiv"]), rng.choice(["", "Royal Arena", "Royal", "The Royal Arena", "Blue Room", "ub", "Dome 1", "Dome 2", "Hall"])))
    df = spark.createDataFrame(rows, "concert_id long, artist_id long, concert_date date, city string, venue_name string")
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if linked(a, b):
            x, y = sorted((find(a[0]), find(b[0])))
            root[y] = x
    touched = {x for a, b in itertools.combinations(rows, 2) if linked(a, b) for x in (a[0], b[0])}
    want = {x: find(x) for x in touched}
    got = {r.concert_id: r.root for r in pairs.duplicate_groups(df).collect()}
    assert got == want
    shuffled = {r.concert_id: r.root for r in pairs.duplicate_groups(df.repartition(7)).collect()}
    assert shuffled == want


EVENT = "source_event_id string, source_platform string, source_url string, artist_name string, event_name string, venue_name string, city string, country string, event_date string, confidence_score double"


def events(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        who = rng.choice(["Anuv Jain", "The Anuv Jain Band", "Prateek Kuhad", "Prateek Kuhad Live"])
        where = rng.choice(["Royal Arena", "Royal Arena Hall", "Blue Room", "Dome"])
        rows.append((f"e{i:03d}", "SONGKICK", None, who, rng.choice(["Live", None]), where, rng.choice(["Pune", "New Pune", "Oslo"]), "India", str(dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 5))), 0.5))
    df = normalize.normalize_events(spark.createDataFrame(rows, EVENT)).withColumn("event_id", F.col("source_event_id"))
    return df


@pytest.mark.parametrize("seed", range(3))
def test_greedy_duplicates_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        hot = i % 3 == 0  # a third of the rows is one artist
        day = dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 6 if hot else 40))
        rows.append((i, 1 if hot else rng.randint(2, 6), day, rng.choice(["", "Pune", "Oslo", "Rome", "Lima"]), rng.choice(["", "Royal Arena", "Royal", "The Royal Arena", "Blue Room", "ub", "Dome 1", "Dome 2", "Hall"])))
    rows.append((500, 7, None, "Pune", "Hall"))
    ordered = sorted((r for r in rows if r[2]), key=lambda r: (r[1], r[2], r[0]))
    seen, want = set(), {}
    for i, first in enumerate(ordered):
        if first[0] in seen:
            continue
        for later in ordered[i + 1 :]:
            if later[0] not in seen and linked(first, later):
                seen.add(later[0])
                want[later[0]] = first[0]
    df = spark.createDataFrame(rows, "concert_id long, artist_id long, concert_date date, city string, venue_name string").repartition(4)
    assert {r.concert_id: r.leader for r in pairs.greedy_duplicates(df).collect()} == want
    assert pairs.greedy_duplicates(df.limit(0)).count() == 0
    full = df.withColumns({"total_revenue": F.col("concert_id") * 1.0, "tickets_sold": F.lit(None).cast("long"), "capacity": F.lit(0), "avg_ticket_price": F.lit(0.0)})
    merged = pairs.dedup_concerts(full, groups="greedy")
    assert merged.count() == len(rows) - len(want)
    groups = {}
    for r in rows:
        groups.setdefault(want.get(r[0], r[0]), []).append(r[0])
    assert {r.merged for r in merged.collect()} == {len(g) for g in groups.values()}


def test_scored_duplicates_against_all_pairs(spark):
    e = pairs.with_embedding(events(spark).dropDuplicates(["canonical_key"])).cache()
    got = {(r.event_id, r.canon_id): r.similarity for r in pairs.score_duplicates(pairs.candidate_pairs(e, e), e, e).collect()}
    a, b = e.alias("a"), e.alias("b")
    near = (F.abs(F.datediff("a.event_date", "b.event_date")) <= 2) & (F.col("a.event_id") != F.col("b.event_id")) & (
        F.contains("b.normalized_artist_name", "a.normalized_artist_name") | F.contains("b.normalized_venue_name", "a.normalized_venue_name") | (F.col("a.normalized_city") == F.col("b.normalized_city")))
    every = a.join(b, near).select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("canon_id"))
    want = {(r.event_id, r.canon_id): r.similarity for r in pairs.score_duplicates(every, e, e).collect()}
    assert want and got == want


@pytest.mark.parametrize("few", [pairs._FEW, 2])
@pytest.mark.parametrize("own", [True, False])
def test_texts_are_scored_where_they_meet(spark, monkeypatch, few, own):
    """Without vectors: one join for all pairs, rows that grow with the events, and the scores that vectors give."""
    monkeypatch.setattr(pairs, "_FEW", few)  # 2: every word is frequent
    e = cut_lineage(events(spark).dropDuplicates(["canonical_key"]))
    c = e if own else e.where("event_date > '2024-01-02'")
    vectors = pairs.with_embedding(e)
    every = e.select("event_id").crossJoin(c.select(F.col("event_id").alias("canon_id"))).where("event_id <> canon_id")
    days = {r.event_id: r for r in e.collect()}

    def near(r):
        a, b = days[r.event_id], days[r.canon_id]
        close = a.normalized_artist_name in b.normalized_artist_name or a.normalized_venue_name in b.normalized_venue_name or a.normalized_city == b.normalized_city
        return close and abs((a.event_date - b.event_date).days) <= 2

    want = {(r.event_id, r.canon_id): r.similarity for r in pairs.score_duplicates(every, vectors, vectors).collect() if near(r)}
    found = pairs.candidate_pairs(e, c)
    scored = pairs.score_duplicates(found, e, c)
    got = [(r.event_id, r.canon_id, r.similarity) for r in scored.collect()]
    assert want and {x[:2]: x[2] for x in got} == pytest.approx(want, abs=1e-9) and len(got) == len(want)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1 and "map<" not in found._jdf.schema().simpleString()


def test_text_cosine_equals_the_stored_vectors(spark):
    texts = ["anuv jain live royal arena pune India 2024-01-01", "anuv jain  anuv\tjain", "  ", "caf\u00e9 \U0001F3B5 x\u00a0y", "a", "royal arena", " ".join(f"w{i % 700}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    made = {r.id: r.embedding for r in V.hash_embed(df, "id", "t").collect()}
    both = df.crossJoin(df.toDF("other", "u")).select("id", "other", V.text_cosine(F.col("t"), F.col("u")).alias("cos"))
    for r in both.collect():
        a, b = made.get(r.id, {}), made.get(r.other, {})
        norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        assert r.cos == pytest.approx(sum(x * b.get(i, 0.0) for i, x in a.items()) / norm if norm else 0.0, abs=1e-12)
    vector = V.text_vectors()
    assert {i: vector(t)[0] for i, t in enumerate(texts) if i in made} == made


def test_common_words_pair_nothing(spark):
    rows = [(f"e{i:03d}", "SONGKICK", None, f"Customer {1000 + i}", "Live", f"Royal Arena {i % 5}", "Pune", "India", "2024-01-01", 0.5) for i in range(40)]
    e = normalize.normalize_events(spark.createDataFrame(rows, EVENT)).withColumn("event_id", F.col("source_event_id")).cache()
    # two artists of two words that share one cannot reach the score, however equal the rest
    assert pairs.candidate_pairs(e, e).count() == 0


def test_resolution_does_not_depend_on_row_order(spark):
    e = events(spark)
    one = {(r.event_id, r.target, r.action) for r in pairs.resolve_events(e).select("event_id", "target", "action").collect()}
    two = {(r.event_id, r.target, r.action) for r in pairs.resolve_events(e.repartition(5, "event_name")).select("event_id", "target", "action").collect()}
    assert one == two and len(one) == 90
    created = {x[0] for x in one if x[2] == "created"}
    assert {x[1] for x in one} <= created
    again = pairs.resolve_events(e, e)
    assert {r.action for r in again.select("action").distinct().collect()} == {"updated"}


def test_winner_and_merge(spark):
    ddl = "concert_id long, artist_id long, concert_date date, city string, venue_name string, total_revenue double, tickets_sold long, capacity long, avg_ticket_price double"
    d = dt.date(2024, 1, 1)
    rows = [(1, 1, d, "Pune", None, 0.0, 0, 0, None), (2, 1, d, "Pune", "Dome", 500.0, 0, 100, 5.0), (3, 1, d, "Oslo", "Dome", 1.0, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, ddl)
    kept = {r.concert_id: r for r in pairs.dedup_concerts(df).collect()}
    assert set(kept) == {2, 3} and kept[2].merged == 2
    first = {r.concert_id: r for r in pairs.dedup_concerts(df, winner="first").collect()}
    assert set(first) == {1, 3} and (first[1].venue_name, first[1].total_revenue, first[1].capacity) == ("Dome", 500.0, 100)


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k long, v long, w string")
    delta = spark.createDataFrame([(2, 0), (3, 30)], "k long, v long")
    merge = {"v": lambda new, old: F.coalesce(F.when(new != 0, new), old, F.lit(0))}
    once = tables.upsert(base, delta, ["k"], merge)
    twice = tables.upsert(once, delta, ["k"], merge)
    want = {(1, 10, "a"), (2, 20, "b"), (3, 30, None)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_vectors_are_fetched_only_for_pairs_that_can_reach_the_threshold(spark):
    """Names are compared before the vectors are joined; words are made per event, not per pair; the scores stay."""
    rows = [(i, f"Artist {i % 3} Group", f"Hall {i % 5} North", "Pune" if i % 7 else "Delhi", dt.date(2024, 1, 1 + i % 3), {1: 0.6, 2 + i % 2: 0.8}) for i in range(24)]
    ev = spark.createDataFrame(rows, "event_id long, artist_name string, venue_name string, city string, event_date date, embedding map<int,double>")
    both = ev.select("event_id").crossJoin(ev.select(F.col("event_id").alias("canon_id"))).where("event_id <> canon_id")
    scored = pairs.score_duplicates(both, ev, ev)
    joins = [line for line in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert sum("Inner" in line for line in joins) == 4
    got = {(r.event_id, r.canon_id): r.similarity for r in scored.collect()}
    jac = lambda a, b: len(set(a.lower().split()) & set(b.lower().split())) / len(set(a.lower().split()) | set(b.lower().split()))
    want = {}
    for a in rows:
        for b in rows:
            gap = abs((a[4] - b[4]).days)
            cos = sum(w * b[5].get(k, 0.0) for k, w in a[5].items())
            s = 0.42 * cos + 0.22 * jac(a[1], b[1]) + 0.18 * jac(a[2], b[2]) + 0.1 * jac(a[3], b[3]) + 0.08 * (1.0, 0.9, 0.65)[gap]
            if a[0] != b[0] and s >= 0.86 - 4e-5:
                want[a[0], b[0]] = round(s, 3)
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_names_are_cleaned_once_and_looked_up_by_the_sizes_in_use(spark, monkeypatch):
    plans, cut = [], pairs.cut_lineage

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(pairs, "cut_lineage", keep)
    names = ["Ann Bell", "Q", "Ana", "Zo", "Ann Bell Trio", "Coldwater Kings", "Kings"]
    events = spark.createDataFrame([(n,) for n in [*names, "Queen Zola", "Ann Bell Trio", "&", ""] * 3], "artist_name string")
    artists = spark.createDataFrame(list(enumerate(names)), "artist_id long, artist_name string")
    got = {(r.artist_name, r.artist_id) for r in pairs.match_artist(events, artists).collect()}
    # nothing below the distinct cleans a name
    assert "regexp_replace" not in plans[0][plans[0].index("Aggregate"):]
    assert got == {*((n, i) for i, n in enumerate(names)), ("Queen Zola", 3)}
    long = spark.createDataFrame([("abcdefgh",)], "t string")
    assert pairs.gram_sizes(long, "t") == [6] and sorted(pairs.gram_sizes(artists, "artist_name")) == [1, 2, 3, 6]
    small, big = long.select(F.col("t").alias("a"), F.col("t").alias("a_text")), long.select(F.col("t").alias("b"), F.concat(F.lit("x"), "t").alias("b_text"))
    assert [tuple(r) for r in pairs.contained_pairs(small, big, sizes=[6]).collect()] == [("abcdefgh", "abcdefgh")]


def test_new_concerts_are_looked_up_in_one_join(spark, monkeypatch):
    day, plans, cut = dt.date(2024, 1, 5), [], tables.cut_lineage

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(tables, "cut_lineage", keep)
    ddl = "artist_name string, event_name string, venue_name string, city string, country string, concert_date date, price_min double, price_max double, currency string, source string, source_url string"
    rest = ("IN", day, 1.0, 2.0, "INR", "s", "")
    scraped = [("Ann Bell", "show", v, c, *rest) for v in ("Hall", "Club", "", None) for c in ("Pune", "Delhi", None)]
    artists = spark.createDataFrame([(1, "Ann Bell")], "artist_id long, artist_name string")
    concerts = spark.createDataFrame(
        [(5, 1, "Ann Bell", day, "Hall", "Pune"), (6, 1, "Ann Bell", day, None, "Delhi"), (7, 1, "Ann Bell", day, "Hall", None)],
        "concert_id long, artist_id long, artist_name string, concert_date date, venue_name string, city string")
    out = tables.insert_new_concerts(spark.createDataFrame(scraped, ddl), concerts, artists)
    # no row without a venue where the city has a concert, no stored venue; an unknown city equals none
    want = sorted([("Pune", "Club"), ("Delhi", "Hall"), ("Delhi", "Club"), ("TBA", "Hall"), ("TBA", "Club"), ("TBA", "")])
    assert sorted((r.city, r.venue_name or "") for r in out.where("concert_id < 0").collect()) == want
    assert plans[0].count("Join") == 1
