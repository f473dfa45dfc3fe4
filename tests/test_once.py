"""Costly expressions are worked out once a row, or once a distinct value, and rows are dealt out before they multiply."""

from pyspark.sql import functions as F

from backline.functions import dates, text as X
from backline.operators import capacity, series


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_made_history_is_spread_over_tasks(spark):
    cols = ["spotify_listeners", "youtube_subscribers", "instagram_followers", "facebook_followers", "twitter_followers"]
    artists = spark.range(50).coalesce(1).select(F.col("id").alias("artist_id"), *[(F.col("id") + 7).alias(c) for c in cols])
    made = series.synthesize_metrics(artists, "2024-01-31")
    parts = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 4 and sum(r["count"] for r in parts) == 50 * 5 * 90


def test_name_keys_are_made_once(spark):
    df = spark.createDataFrame([("The Kites & Band", "kites"), ("Kites", "Kites Official"), ("a b", "b c"), ("", "x"), (None, "x"), ("Zoë", "zoe live")], "a string, b string")
    out = df.select(X.artist_match(F.col("a"), F.col("b")).alias("m"), X.jaccard(F.col("a"), F.col("b")).alias("j"))
    assert plan(out).count("regexp_replace(") <= 14
    got = [tuple(x if x is None else round(x, 3) for x in r) for r in out.collect()]
    assert got == [(0.86, 0.25), (1.0, 0.5), (0.333, 0.333), (0.0, 0.0), (0.0, None), (0.86, 0.0)]


def test_known_venues_are_searched_per_place(spark):
    rows = spark.range(20).select(F.col("id").alias("concert_id"), F.when(F.col("id") % 3 == 0, "Madison Square Garden").when(F.col("id") % 3 == 1, "Nowhere").alias("venue_name"), F.lit("New York").alias("city"))
    out = capacity.with_known_capacity(rows)
    text = plan(out)
    # the search of the list stands above the distinct, and nothing like it below
    assert text.index("Generate explode") < text.index("Aggregate") and "contains" not in text[text.index("Aggregate"):]
    got = {r.concert_id: r.known_capacity for r in out.collect()}
    assert len(got) == 20 and all((got[i] is not None) == (i % 3 == 0) for i in got)


def test_dates_are_read_once(spark):
    texts = ["Thu, 5 Mar 2026", "moved from Feb 1, 2025", "Doors 15 Jan", "Jun 9 show", "7 Aug 2019", "31 Feb 2026", "none", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(dates.date_from_text(F.col("t"), "2025-06-01").cast("string").alias("d"))
    assert plan(out).count("regexp_extract(") <= 10
    assert [r.d for r in out.collect()] == ["2026-03-05", "2025-02-01", "2026-01-15", "2025-06-09", "2025-08-07", "2026-02-20", None, None, None]
