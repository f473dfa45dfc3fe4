"""Blocked smoothing, segmentation in linear memory, folds of the revenue model, hand-written text rows."""

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from backline.operators import capacity, normalize, revenue, series

DAY = dt.date


def test_smoothing_over_blocks_equals_the_loop(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for artist, days in ((1, 900), (2, 1), (3, 130)):
        at = sorted(rng.choice(3000, days, replace=False).tolist())
        x = rng.integers(0, 10**7, days).astype(float)
        s = pd.Series(x).ewm(alpha=0.3, adjust=False).mean()
        want |= {(artist, d): v for d, v in zip(at, s)}
        rows += [(artist, "twitter", DAY(1968, 1, 1) + dt.timedelta(d), v) for d, v in zip(at, x.tolist())]
    df = spark.createDataFrame(rows, "artist_id long, platform string, date date, x double").repartition(5)
    for days in (7, 128):
        got = {(r.artist_id, (r.date - DAY(1968, 1, 1)).days): r.s for r in series.smooth(df, days=days).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * want[k] + 1e-9 for k in want)
    assert series.smooth(df.limit(0)).count() == 0


def dense_change_points(x, penalty, min_size=2, jump=5):
    """The same segmentation with the whole kernel matrix."""
    n = len(x)
    d = (x[:, None] - x[None]) ** 2
    med = float(np.median(d[np.triu_indices(n, 1)]))
    k = np.exp(-np.clip(d * (1 / med if med else 1.0), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = k.cumsum(0).cumsum(1)
    best, back, live = {0: 0.0}, {}, [0]
    for e in [e for e in range(0, n, jump) if e >= min_size] + [n]:
        cost = {t: best[t] + (e - t) - (area[e, e] - area[t, e] - area[e, t] + area[t, t]) / (e - t) + penalty for t in live if e - t >= min_size}
        if cost:
            back[e] = min(cost, key=cost.get)
            best[e] = cost[back[e]]
            live = [t for t in live if t not in cost or cost[t] <= best[e] + penalty] + [e]
    cuts, at = [], n
    while back.get(at, 0) > 0:
        at = back[at]
        cuts.append(at)
    return sorted(cuts)


@pytest.mark.parametrize("seed", range(8))
def test_segmentation_equals_the_dense_one(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.normal(0, 5), rng.uniform(0.2, 2), rng.integers(3, 40)) for _ in range(rng.integers(1, 9))])
    if seed % 2:
        x = np.round(x)  # ties
    assert series.change_points(x, 5.0) == dense_change_points(x, 5.0)
    assert series.change_points(x, 1.0) == dense_change_points(x, 1.0)


def test_median_of_gaps():
    rng = np.random.default_rng(0)
    for x in (rng.normal(0, 1, 50), rng.integers(0, 4, 31).astype(float), np.full(9, 3.0), rng.uniform(-1e9, 1e9, 2)):
        d = (x[:, None] - x[None]) ** 2
        assert series.median_square_gap(x) == pytest.approx(np.median(d[np.triu_indices(len(x), 1)]), rel=1e-12)


def test_long_series_in_little_memory():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(10 * (k % 3), 1, 2500) for k in range(20)])
    tracemalloc.start()
    cuts = series.change_points(x, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == 50_000 and cuts == list(range(2500, 50_000, 2500)) and peak < 500e6


def test_folds(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(160):
        cap, price = float(rng.integers(500, 20000)), float(rng.integers(5, 90))
        rows.append((k, 1, cap, price, 5.0, cap * price, float(k % 2), float(k % 12 + 1), float(k % 100), 1.0, 50.0, "summer", f"c{k % 4}", "India", "mid", cap * price * 0.6))
    names = ["concert_id", "artist_id", *revenue.NUMERIC, *revenue.CATEGORICAL, "actual_revenue"]
    frame = spark.createDataFrame(rows, names)
    preds = revenue.out_of_fold(frame, folds=4, trees=8, depth=3, leaf=2).cache()
    assert preds.count() == 160 and preds.where("prediction is null").isEmpty() and {r.fold for r in preds.select("fold").distinct().collect()} == set(range(4))
    # a prediction comes from the model of the other folds
    alone = revenue.train_revenue(frame.join(preds.where("fold <> 2").select("concert_id"), "concert_id"), 8, 3, 2)
    own = preds.where("fold = 2")
    again = {r.concert_id: r.prediction for r in alone.transform(own.drop("prediction")).collect()}
    assert all(abs(again[r.concert_id] - r.prediction) < 1e-6 * abs(r.prediction) for r in own.collect())
    rated = {r.fold: r for r in revenue.evaluate_folds(preds).collect()}
    assert set(rated) == {None, 0, 1, 2, 3} and rated[None].rows == 160 == sum(rated[k].rows for k in range(4))
    pdf = preds.toPandas()
    for fold, part in [(None, pdf), *pdf.groupby("fold")]:
        err = part["actual_revenue"] - part["prediction"]
        assert rated[fold].mae == pytest.approx(err.abs().mean()) and rated[fold].r2 == pytest.approx(1 - (err**2).sum() / ((part["actual_revenue"] - part["actual_revenue"].mean()) ** 2).sum())
    assert rated[None].r2 > 0.5


def test_place_rules(spark):
    from backline.operators import checks

    df = spark.createDataFrame([(1, 90.0, -180.0), (2, 90.5, 0.0), (3, None, 181.0), (4, None, None)], "id int, latitude double, longitude double")
    good, bad = checks.check_constraints(df, checks.place_rules())
    assert {r.id for r in good.collect()} == {1, 4} and {(r.id, *r.failed) for r in bad.collect()} == {(2, "latitude range"), (3, "longitude range")}


# --- rows written by hand for the text patterns ------------------------------------------------


def test_capacity_texts_by_hand(spark):
    rows = [
        ("a", "Seating capacity of about 12,500 people"), ("b", "max capacity: 2.5k"), ("c", "1.2 m crowd expected"), ("d", "Opened in 1987, holds many"), ("e", "standing capacity 900, 850 seats"),
        ("f", ""), ("g", None),
    ]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {(r.k, r.capacity, r.method.split("_")[0], round(r.confidence, 2)) for r in capacity.capacity_candidates(df, "k").collect()}
    assert got == {
        ("a", 12500, "context", 0.78), ("a", 12500, "inline", 0.58), ("b", 2500, "context", 0.9), ("c", 1200000, "inline", 0.7), ("e", 900, "context", 0.9), ("e", 850, "inline", 0.7),
    }


def test_snippets_by_hand(spark):
    rows = [
        ("v1", "Blue Hall", "organic", "Blue Hall", "a hall for 3,000 with 2,950 seats", "https://en.wikipedia.org/x"),
        ("v2", "Red Club", "organic", "t", "accommodates up to 400; capacity: 380", "https://x.example"),
        ("v3", "Old Arena", "answer_box", "", "15000-seat arena", ""),
        ("v4", "None", "organic", "no numbers", "", ""),
    ]
    df = spark.createDataFrame(rows, "venue_key string, venue_name string, section string, title string, snippet string, link string")
    got = {(r.venue_key, r.capacity, round(r.confidence, 2)) for r in capacity.snippet_capacity(df).collect()}
    assert got == {("v1", 3000, 0.88), ("v1", 2950, 0.88), ("v2", 400, 0.78), ("v2", 380, 0.78), ("v3", 15000, 0.90)}


@pytest.mark.parametrize("title,artist", [
    ("Asha Rao - Live in Mumbai", "Asha Rao"), ("Asha Rao | Tour 2025", "Asha Rao"), ("The Band Live", "The Band"), ("The Band: In Concert at Night", "The Band"), ("Live", "Live"),
    ("Solo Performing", "Solo"), ("Mixed-Tape", "Mixed-Tape"), ("A – Pune edition", "A"),
])
def test_artists_by_hand(spark, title, artist):
    assert spark.range(1).select(normalize.artist_from_title(F.lit(title))).first()[0] == artist


@pytest.mark.parametrize("venue,key", [("NSCI Dome, Mumbai", "NSCI Dome"), ("Dome - INDIA", "Dome"), ("Mumbai", "Mumbai"), ("Hall  of   Fame", "Hall of Fame"), ("Delhi Hall, Pune", "Delhi Hall, Pune"), (None, "")])
def test_venues_by_hand(spark, venue, key):
    assert spark.range(1).select(normalize.venue_key(F.lit(venue).cast("string"))).first()[0] == key


def test_series_of_any_length_share_a_task(spark):
    """Holt, break dates and the report: the series of a task go to Python as arrays, and each keeps its own result."""
    rng = np.random.default_rng(5)
    start = dt.date(2020, 1, 1)
    rows = [(a, "spotify", start + dt.timedelta(days=d), float(x)) for a, n in enumerate([1, 2, 3, 13, 14, 40, 200, 600, 0]) for d, x in enumerate(np.cumsum(rng.normal(size=n)) * 50 + 1000 * (np.arange(n) > n // 2))]
    df = spark.createDataFrame(rows, "artist_id long, platform string, date date, x double")
    holt, cuts = series.forecast_holt(df), series.breakpoints(df)
    for plan in (holt, cuts):
        assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    together = {r.artist_id: tuple(r)[2:] for r in holt.collect()}
    found = {(r.artist_id, r.date) for r in cuts.collect()}
    for a in (0, 1, 2, 3, 6, 7):
        alone = df.where(df.artist_id == a)
        assert together[a] == tuple(series.forecast_holt(alone).first())[2:]
        s = pd.Series([r[3] for r in rows if r[0] == a]).ewm(alpha=0.3, adjust=False).mean().to_numpy()
        want = [start + dt.timedelta(days=c) for c in (series.change_points(s, 5.0) if len(s) >= 14 else [])]
        assert sorted(d for i, d in found if i == a) == want
    metrics = df.selectExpr("artist_id", "platform", "date", "case when artist_id <> 2 then x end as streams", "0.0 as views", "0.0 as followers")
    report = series.growth_report(metrics)
    assert report._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    got = {r.artist_id: r for r in report.collect()}
    assert set(got) == set(range(8)) and got[2].platforms is None and got[2].cross_platform_score == 50.0 and got[2].breakpoints == []
    assert {(a, dt.date.fromisoformat(d)) for a, r in got.items() for d in r.breakpoints} == found


def test_short_and_long_segmentation_agree(monkeypatch):
    rng = np.random.default_rng(6)
    for n in (14, 15, 63, 300, 512):
        x = np.repeat(rng.normal(size=n // 7 + 1) * 9, 7)[:n] + rng.normal(size=n)
        with monkeypatch.context() as m:
            m.setattr(series, "_SHORT", 0)
            want = series.change_points(x, 1.0)
        assert series.change_points(x, 1.0) == want
