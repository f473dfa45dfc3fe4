"""Exact values for rates, tiers, popularity, capacity and prices."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from backline.functions.rounding import half_even, half_up
from backline.operators import capacity, checks, demand, money, normalize, popularity, pricing, series

DAY = dt.date


def one(spark, col, **vals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in vals.items()]).select(col.alias("x")).first().x


def test_rounding_rules(spark):
    assert one(spark, half_even(F.lit(2.5))) == 2.0
    assert one(spark, half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, half_up(F.lit(-2.5))) == -2.0
    assert one(spark, half_up(F.lit(0.125), 2)) == 0.13


@pytest.mark.parametrize("t,c,capped,raw", [(4800, 5000, 0.96, 0.96), (10, 0, 0.0, 0.0), (None, 5000, 0.0, 0.0), (-10, 5000, 0.0, 0.0), (5500, 5000, 1.0, 1.1)])
def test_sell_through(spark, t, c, capped, raw):
    df = spark.createDataFrame([(t, c)], "tickets_sold long, capacity long")
    r = demand.with_sell_through(df).first()
    assert (r.sell_through, r.sell_through_uncapped, r.sell_through_pct) == (capped, raw, round(capped * 100, 2))


def test_ticket_velocity(spark):
    as_of = DAY(2024, 6, 1)
    rows = [(1, as_of - dt.timedelta(d), t, 5000) for d, t in ((10, 2500), (20, 5500), (120, 5000))]
    df = spark.createDataFrame(rows, "artist_id long, concert_date date, tickets_sold long, capacity long")
    assert demand.ticket_velocity(df, "2024-06-01").first().ticket_velocity == 0.75


def test_seasonality(spark):
    assert one(spark, demand.seasonality(F.lit("2024-08-03").cast("date"))) >= 0.9
    assert one(spark, demand.seasonality(F.lit("2024-02-05").cast("date"))) <= 0.65


def test_recency_future_show_counts_as_recent(spark):
    c = spark.createDataFrame([(1, "Pune", "India", DAY(2024, 2, 1)), (2, "Oslo", "Norway", DAY(2020, 1, 1))], "artist_id long, city string, country string, concert_date date")
    t = spark.createDataFrame([(1, "pune", "x"), (1, "y", "INDIA"), (2, "Pune", "India"), (3, "Pune", "India")], "artist_id long, city string, country string")
    got = {(r.artist_id, r.city): r.recency for r in demand.recency(t, c, "2024-01-15").collect()}
    assert got == {(1, "pune"): 0.2, (1, "y"): 0.2, (2, "Pune"): 0.7, (3, "Pune"): 0.5}


def linear(spark, days, start, step, platform="instagram", artist=1):
    rows = [(artist, platform, DAY(2024, 1, 1) + dt.timedelta(i), start + i * step) for i in range(days)]
    return spark.createDataFrame(rows, "artist_id long, platform string, date date, x double")


def test_growth_guards(spark):
    g = series.growth_windows(linear(spark, 90, 1e5, 500.0)).first()
    assert g.rog_30d == round((500 * 30) / (1e5 + 500 * 59) * 100, 4) and g.rog_90d == 0.0
    assert series.growth_windows(linear(spark, 60, 0.0, 0.0)).first().rog_30d == 0.0
    assert series.growth_windows(linear(spark, 1, 5.0, 0.0)).first().rog_7d == 0.0


def test_smoothing_forecast_anomaly_match_loops(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 10, 40)) + 500
    x[-1] += 400
    rows = [(1, "twitter", DAY(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "artist_id long, platform string, date date, x double")
    s = pd.Series(x).ewm(alpha=0.3, adjust=False).mean()
    got = [r.s for r in series.smooth(df).orderBy("date").collect()]
    assert np.allclose(got, s)
    u = s.ewm(alpha=0.3, adjust=False).mean().to_numpy()
    want = max(0.0, u[-1] + (u[-1] - u[-3]) / 2 * 30)
    assert series.forecast(df).first().forecast_30d == pytest.approx(want, abs=0.01)
    r = x - s.to_numpy()
    assert series.anomalies(df).first().anomaly is True and abs(r[-1]) / r.std(ddof=1) > 3.0
    assert series.anomalies(linear(spark, 6, 1.0, 1.0)).first().anomaly is False


def test_holt_extends_a_line(spark):
    f = series.forecast_holt(linear(spark, 60, 100.0, 5.0)).first().forecast_30d
    lag = 2 * 0.7 / 0.3 * 5  # smoothing twice trails a line by this much
    assert f == pytest.approx(100 + 5 * 89 - lag, rel=0.01)


def test_breakpoint_at_level_shift(spark):
    x = np.r_[np.zeros(40), np.full(40, 100.0)] + np.sin(np.arange(80))
    cuts = series.change_points(x, 5.0)
    assert len(cuts) == 1 and abs(cuts[0] - 40) <= 5
    assert series.change_points(np.full(30, 7.0), 5.0) == []
    assert series.breakpoints(linear(spark, 10, 1.0, 1.0)).count() == 0


def test_segmentation_is_optimal():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, 20), rng.normal(4, 1, 15), rng.normal(-3, 1, 20)]
    n, jump, pen = len(x), 5, 3.0
    d = (x[:, None] - x[None]) ** 2
    k = np.exp(-np.clip(d / np.median(d[np.triu_indices(n, 1)]), 1e-2, 1e2))
    np.fill_diagonal(k, 1)
    cost = lambda i, j: (j - i) - k[i:j, i:j].sum() / (j - i)
    ends = [e for e in range(5, n, jump)] + [n]
    best, back = {0: 0.0}, {}
    for e in ends:
        best[e], back[e] = min((best[s] + cost(s, e) + pen, s) for s in best if s < e)
    cuts, at = [], n
    while back[at]:
        at = back[at]
        cuts.append(at)
    assert series.change_points(x, pen) == sorted(cuts)


def test_late_day_changes_two_growth_values(spark, tmp_path):
    from backline.streaming.metrics import metric_table, refresh_growth

    rows = [(1, "twitter", DAY(2024, 1, d), f) for d, f in ((1, 100), (3, 120), (4, 130))]
    table = spark.createDataFrame(rows, "artist_id long, platform string, date date, followers long").withColumn("rog_daily", F.lit(None).cast("double"))
    delta = table.where("date = date '2024-01-03'")
    stored = metric_table(spark, str(tmp_path))
    stored.upsert(table)
    got = {r.date.day: r.rog_daily for r in refresh_growth(delta, stored).collect()}
    assert got == {3: 20.0, 4: pytest.approx(8.3333)}


SNAP = [("artist_001", True, 100000, 50000, 80000, 20000, 15000), ("artist_002", True, 50000, 30000, 40000, 10000, 5000)]
SNAP_DDL = "artist_id string, active boolean, spotify_listeners long, youtube_subscribers long, instagram_followers long, facebook_followers long, twitter_followers long"


def entropy(cols):
    z = np.log1p(np.array(cols, float))
    p = z / z.sum(0)
    e = -(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)).sum(0) / math.log(len(z))
    d = np.maximum(0, 1 - e)
    return d / d.sum()


def test_entropy_weights(spark):
    df = spark.createDataFrame(SNAP, SNAP_DDL)
    want = entropy([r[2:] for r in SNAP])
    got = {r.platform: r.weight for r in popularity.entropy_weights(df, popularity.FIVE).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert [got[p] for p in popularity.FIVE] == pytest.approx(list(want))
    lifted = {r.platform: r.weight for r in popularity.entropy_weights(df, popularity.FOUR, 0.40).collect()}
    assert sum(lifted.values()) == pytest.approx(1.0) and lifted["spotify"] >= 0.40 - 1e-9


def test_popularity_without_reach(spark):
    df = spark.createDataFrame([("a", True, 0, None, 0, None, 0)], SNAP_DDL)
    assert {r.weight for r in popularity.entropy_weights(df, popularity.FIVE).collect()} == {0.2}
    assert popularity.popularity_service(df).first().popularity == 45.0


def test_capacity_from_text(spark):
    t = spark.createDataFrame([(1, "The arena has a seating capacity of 12,500 for concerts."), (1, "Standing capacity 2k depending on the configuration.")], "venue_key long, text string")
    assert {r.capacity for r in capacity.capacity_candidates(t, "venue_key").collect()} == {2000, 12500}


def test_capacity_resolution(spark):
    ddl = "venue_key long, venue_name string, city string, country string, venue_type string, artist_tier string, supplied_capacity long"
    rows = [(1, "Example Arena", "Mumbai", "India", "arena", None, 15000), (2, "Sample Club", "Indore", "India", "club", "rising", None), (3, "Known Stadium", "Mumbai", "India", "stadium", None, None),
            (4, "venue", "Mumbai", "", "", "superstar", None), (5, "venue", "Indore", "", "", "superstar", None), (6, "The O2 Arena", "London", "UK", "", None, 9)]
    stored = spark.createDataFrame([(9, "known stadium", "mumbai", "india", 45000, 50000, 48000, True)], "venue_id long, venue_name string, city string, country string, capacity_min long, capacity_max long, avg_capacity long, verified boolean")
    got = {r.venue_key: r for r in capacity.resolve_capacity(spark.createDataFrame(rows, ddl), stored).collect()}
    assert (got[1].capacity, got[1].source, got[1].status) == (15000, "supplied", "validated")
    assert got[2].source == "heuristic"
    assert (got[3].capacity, got[3].source, got[3].status) == (48000, "venue_db", "validated")
    assert (got[4].capacity, got[5].capacity) == (20000, 14400)
    assert (got[6].capacity, got[6].source) == (20000, "known_venues_db")


def test_currency_quirk(spark):
    assert one(spark, money.currency_of(F.lit("Australia"))) == "AUD"
    assert one(spark, money.currency_of(F.lit("Australia"), first_hit=True)) == "USD"


def test_pricing_rows(spark):
    rows = [(75.0, 60.0, 3500, "Plano", ""), (90.0, 85.0, 50000, "Mumbai", "stadium")]
    df = spark.createDataFrame(rows, "artist_popularity double, city_popularity double, venue_capacity long, city string, venue_type string")
    a, b = pricing.predict_sales(pricing.price_tiers(df)).collect()
    base = (800 + 75 * 12 + 60 * 8) * 1.0
    assert (a.vip, a.tier2) == (round(base * 4.5), round(base))
    assert a.tickets_sold == round(3500 * min(0.9, min(0.85, 0.25 + ((60 * 0.65 + 75 * 0.25) - 10) / 85 * 0.5) * 1.1))
    assert b.tickets_sold <= 50000 * 0.9


def test_repair_order(spark):
    ddl = "concert_id long, artist_id long, capacity long, tickets_sold long, avg_ticket_price double, total_revenue double, source string, verification_status string"
    rows = [(1, 1, 1000, 1500, 10.0, 5.0, "manual", "PENDING"), (2, 1, 1000, 100, 10.0, 5.0, "songkick", "PENDING"), (3, 1, 1000, 500, 10.0, 0.0, "setlistfm", "PENDING")]
    artists = spark.createDataFrame([(1, 80.0)], "artist_id long, popularity double")
    got = {r.concert_id: r for r in checks.repair_concerts(spark.createDataFrame(rows, ddl), artists).collect()}
    assert (got[1].tickets_sold, got[1].total_revenue, got[1].verification_status) == (850, 8500.0, "VERIFIED")
    assert got[2].tickets_sold == 820 and got[2].total_revenue == 8200.0
    assert (got[3].total_revenue, got[3].verification_status) == (5000.0, "PENDING")


def test_normalized_event_golden_row(spark):
    ddl = "artist_name string, event_name string, venue_name string, city string, country string, event_date string, confidence_score double"
    rows = [("Anuv Jain", "Anuv Jain Live", "Forum Melbourne, Melbourne, VIC, Australia", None, None, "2026-08-06T19:00:00+1000", 0.8),
            ("dj  beyoncé & co", "x", "Hall Pvt", "bombay", "in", "2026-01-01", None), ("x", "x", "Hall", "Pune", "India", "soon", None), (None, "x", "Hall", "Pune", "India", "2026-01-01", None)]
    got = normalize.normalize_events(spark.createDataFrame(rows, ddl)).orderBy("artist_name").collect()
    assert len(got) == 2
    a, b = got
    assert (a.venue_name, a.city, a.country, a.event_date) == ("Forum Melbourne", "Melbourne", "Australia", DAY(2026, 8, 6))
    assert (b.artist_name, b.city, b.country, b.normalized_artist_name) == ("DJ Beyoncé & Co", "Mumbai", "India", "dj beyonce and co")


def test_normalizing_moves_no_listing(spark, monkeypatch):
    """Only the distinct places are shuffled, not the listings; places too many to be sent give the same rows."""
    ddl = "artist_name string, event_name string, venue_name string, city string, country string, event_date string, confidence_score double"
    rows = [(f"the act {i} | Band", "x", f"Hall {i % 3} Pvt Ltd", None if i % 2 else "bombay", "in", "2026-01-02" if i % 5 else "soon", None) for i in range(40)]
    rows += [(None, "x", "Hall", "Pune", "India", "2026-01-02", 0.5), (" | ", "x", "Hall", "Pune", "India", "2026-01-02", 0.5), ("Ann", "x", "Hall, Pune", None, "India", "2026-01-02", 0.5)]
    raw = spark.createDataFrame(rows, ddl)
    got = normalize.normalize_events(raw)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan, plan
    monkeypatch.setattr(normalize, "PLACES_SENT", 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, normalize.normalize_events(raw).collect())) and got.count() > 16
